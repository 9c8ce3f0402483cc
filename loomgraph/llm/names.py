"""Variant spellings of names typed by people, by noisy-channel attribution.

Which words qualify names is learned from all rows: in an organisation, vessel or place a word that stands beside many
different rarer words is a qualifier; in a person the two parts are told apart by where each stands elsewhere. Short forms
are read as the qualifiers of the same place in the name that they can abbreviate, all of them if there are several.

A name is read into its kind, its core word and what qualifies it (given name or initial, number, kind of place, the two
words of an organisation). Equal readings are one spelling, with its rows and frequency as prior. Every spelling is
compared with every higher-ranked one whose core word is within the accepted cost of typing errors, wherever they stand:
cores meet in deletion neighbourhoods, and each core's spellings are compared with those of the cores near it. The posterior
of a candidate adds the logarithm of its prior to the likelihood of the typing errors (neighbouring keys, swapped, doubled,
lost and stray letters) and of the abbreviations that turn it into the variant. The spelling is attached to the maximum
posterior, unless it is itself the better explanation: a spelling that is frequent, or whose letter triples look like those
of other names, is more probably a name of its own. Attachments are followed to their roots by pointer jumping.

Comparisons run over sorted blocks, one pass per partition: all candidates of a spelling stand in the block of its core, and
only its best attachment leaves the block.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut

# Spellings of the kinds of things.
KINDS = {"person": "person", "per": "person", "organization": "org", "organisation": "org", "org": "org", "company": "org", "project": "project", "programme": "project", "program": "project",
         "vessel": "vessel", "ship": "vessel", "boat": "vessel", "location": "place", "place": "place", "geo": "place", "gpe": "place", "loc": "place"}
# Common English short forms of given names.
NICKNAMES = {
    "alex": "alexander", "sandy": "alexander", "sasha": "alexander", "andy": "andrew", "tony": "anthony", "art": "arthur", "ben": "benjamin", "charlie": "charles", "chuck": "charles", "chris": "christopher christine", "kit": "christopher",
    "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dot": "dorothy dorothea", "dottie": "dorothy", "thea": "dorothea", "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "edward theodore", "teddy": "edward theodore", "theo": "theodore",
    "ellie": "eleanor eloise", "nell": "eleanor", "liz": "elizabeth", "lizzie": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "betsy": "elizabeth", "eliza": "elizabeth", "fran": "francesca frances francis", "frank": "francis", "fred": "frederick", "freddie": "frederick",
    "gabi": "gabrielle", "gabby": "gabrielle", "greg": "gregory", "hal": "harold henry", "harry": "harold henry", "henk": "hendrik henrik", "izzy": "isidore isabel", "jack": "john", "jake": "jacob", "jim": "james", "jimmy": "james", "joe": "joseph", "jo": "josephine joanna", "josie": "josephine",
    "jon": "jonathan", "jonny": "jonathan", "johnny": "john", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kay": "katherine", "larry": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "lucy": "lucinda", "cindy": "lucinda cynthia",
    "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "mags": "margaret", "matt": "matthew matthias", "mike": "michael", "mick": "michael", "nick": "nicholas", "nico": "nicholas", "pat": "patricia patrick", "patty": "patricia", "trish": "patricia", "pete": "peter", "phil": "philip philippa", "pippa": "philippa",
    "ray": "raymond", "becky": "rebecca", "becca": "rebecca", "dick": "richard", "rich": "richard", "rick": "richard", "rob": "robert", "bob": "robert", "bobby": "robert", "ron": "ronald veronica", "ronnie": "ronald veronica", "sam": "samuel samantha", "sammy": "samuel", "steve": "stephen steven",
    "sue": "susan susannah", "susie": "susan susannah", "tim": "timothy", "tom": "thomas tomasz", "tommy": "thomas", "tomek": "tomasz", "vic": "victor viktor", "vik": "viktor", "will": "william", "bill": "william", "billy": "william", "willie": "william", "quen": "quentin",
}
# Titles, legal forms and words for the kind of thing, which do not tell things of one kind apart.
DROPPED = set("the of and dr mr mrs ms miss prof professor capt captain sir rev phd msc bsc md esq jr sr ltd limited gmbh inc plc registered reg'd no nr number research vessel ship rv mv project proj prj programme program team office".split())
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}

# The rows of a keyboard, from which neighbouring keys follow.
_ROWS = ["qwertyuiop", "asdfghjkl", "zxcvbnm"]
_NEAR = {frozenset((r[k], r[k + 1])) for r in _ROWS for k in range(len(r) - 1)}
_NEAR |= {frozenset((a, b)) for up, low in zip(_ROWS, _ROWS[1:]) for k, b in enumerate(low) for a in (up[k : k + 2] if up is _ROWS[0] else up[k : k + 2])}


#: Words beside fewer different rarer words are no qualifiers; at least this share of all names, which bounds the lexicon.
LEAST_BESIDE, SHARE = 5, 1 / 100_000
#: How many times rarer than its neighbour a word must be to count as a typing error of it.
RARER = 8
#: Ranks from here on are those of full readings.
FULL = 500.0
#: Typing errors may cost up to so much.
MOST = 2.7


def fold(name: str) -> str:
    t = unicodedata.normalize("NFKD", re.sub(r"([a-zà-ÿ])([A-ZÀ-Ý])", r"\1 \2", name))
    t = "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower().replace("’", "'").replace("ß", "ss")
    t = re.sub(r"'s\b", "", t)
    t = re.sub(r"\bph\.? d\b", "phd", t)
    t = re.sub(r"\br\s*[/.]\s*v\b\.?", " rv ", t)
    return t


def one_edit(a: str, b: str) -> bool:
    """At most one letter changed, lost, added or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])


def shortens(a: str, b: str) -> bool:
    """a has the first letter of b and then some of its others in order, at least two letters fewer."""
    if len(a) > len(b) - 2 or len(a) < 2 or a[0] != b[0]:
        return False
    rest = iter(b)
    return all(c in rest for c in a)


class Lexicon:
    """What is known of words: org and place qualifiers with their place in the name ('first', 'second'), and of persons' words how often they stand in each part."""

    def __init__(self, qualifiers: dict[str, list[tuple[str, int, float]]], given: dict[str, tuple[int, int]]) -> None:
        self.place_of: dict[str, dict[str, str]] = {}
        self.full: dict[str, dict[str, str]] = {}
        for kind, rows in qualifiers.items():
            side = {w: "second" if kind == "org" and last >= 0.5 else "first" for w, _, last in rows}
            n = {w: k for w, k, _ in rows}
            self.place_of[kind] = side
            long = {w: [b for b in side if side[b] == side[w] and n[b] > 2 * n[w] and shortens(w, b)] for w in side if len(w) <= 6}
            slips = self._slips(n)
            whole = {w for w in side if not long.get(w) and w not in slips}
            if kind == "org":  # two letters that begin a first and a second qualifier are the initials of both
                heads = {(side[w], w[0]) for w in whole if len(w) > 2}
                initials = {w for w in side if len(w) == 2 and ("first", w[0]) in heads and ("second", w[1]) in heads}
                side = {w: x for w, x in side.items() if w not in initials}
                whole -= initials
                self.place_of[kind] = side
            self.full[kind] = {w: slips[w] if w in slips else self._options(w, long[w], whole) if long.get(w) else w for w in side}
        self.whole = {k: {w for w in f if f[w] == w} for k, f in self.full.items()}
        self.given = given
        # names by position: the usual given names, which rare words are compared with
        self.slips = self._slips({w: g for w, (g, s) in given.items()})
        self.usual = {w for w, (g, s) in given.items() if g >= 4 and g > 2 * s and w not in self.slips}
        self.near = {k: self._index(ws) for k, ws in [*self.whole.items(), ("person", self.usual)]}
        self._known: dict[tuple[str, str], str] = {}

    @staticmethod
    def _options(w: str, long: list[str], whole: set[str]) -> str:
        """The words that w can stand for: those that it begins, else those that have its letters in order."""
        long = [b for b in long if b in whole] or long
        return " ".join(sorted([b for b in long if b.startswith(w)] or long))

    @classmethod
    def _slips(cls, n: dict[str, int]) -> dict[str, str]:
        """Words that are typing errors of a far more frequent one: in a large corpus the same slip is made often enough to look like a word."""
        index = cls._index(set(n))
        out = {}
        for w in n:
            if len(w) >= 5:
                near = {b for d in (w, *(w[:k] + w[k + 1 :] for k in range(len(w)))) for b in index.get(d, ()) if n[b] >= RARER * n[w] and b[0] in w[:2] and one_edit(w, b)}
                if near:
                    out[w] = max(near, key=lambda b: (n[b], b))
        return {w: out.get(b, b) for w, b in out.items()}

    @staticmethod
    def _index(words: set[str]) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for w in sorted(words):
            if len(w) >= 5:
                for d in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
                    out.setdefault(d, []).append(w)
        return out

    def near_word(self, kind: str, t: str) -> str | None:
        """The known word that t is a typing error of, if any; such words have one letter changed, lost, added or swapped."""
        index = self.near.get(kind)
        if not index or len(t) < 5:
            return None
        for d in (t, *(t[:k] + t[k + 1 :] for k in range(len(t)))):
            for w in index.get(d, ()):
                if w[0] in t[:2] and one_edit(t, w):
                    return w
        return None

    def qualifier(self, kind: str, t: str) -> str | None:
        """The qualifier that t is, misspells or abbreviates (several, separated by spaces, where it fits several); None if it is none."""
        got = self._known.get((kind, t))
        if got is None:
            full = self.full.get(kind, {})
            if t in full:
                got = full[t]
            else:
                got = self.near_word(kind, t) or ""
                if not got and (3 if kind == "org" else 2) <= len(t) <= 5:  # two letters are rather the initials of both words
                    got = self._options(t, [b for b in self.whole.get(kind, ()) if shortens(t, b)], self.whole.get(kind, set()))
            if len(self._known) > 100_000:
                self._known.clear()
            self._known[kind, t] = got
        return got or None

    def side(self, kind: str, options: str) -> str:
        return self.place_of[kind][options.split(" ")[0]]

    def givenness(self, t: str, stands: bool) -> float:
        """Log odds that t is a given name rather than a surname, by where it stands in other rows; `stands`: it stands as a given name in this one."""
        if t in NICKNAMES:
            return 3.0
        g, s = self.given.get(t) or (self.given.get(self.near_word("person", t) or "", (0, 0)))
        return math.log((max(0, g - stands) + 0.5) / (max(0, s - (not stands)) + 0.5))

    def given_name(self, t: str) -> str:
        if t in NICKNAMES:
            return NICKNAMES[t]
        if t in self.slips:
            return self.slips[t]
        g, s = self.given.get(t, (0, 0))
        return t if g > 3 else self.near_word("person", t) or t


def typing_cost(x: str, y: str, most: float = 3.0) -> float:
    """The cheapest way to mistype y as x, in typing errors; above `most` the search stops with infinity."""
    if x == y:
        return 0.0
    if abs(len(x) - len(y)) > 2:
        return math.inf
    prev2: list[float] = []
    prev = [1.1 * j for j in range(len(y) + 1)]
    for i in range(1, len(x) + 1):
        row = [1.1 * i]
        for j in range(1, len(y) + 1):
            a, b = x[i - 1], y[j - 1]
            if a == b:
                best = prev[j - 1]
            else:
                best = prev[j - 1] + (1.0 if frozenset((a, b)) in _NEAR else 1.8)
            stray = 0.9 if (j and a == y[j - 1]) or (i > 1 and a == x[i - 2]) else 1.1
            lost = 0.9 if j > 1 and b == y[j - 2] else 1.0
            best = min(best, prev[j] + stray, row[j - 1] + lost)
            if i > 1 and j > 1 and a == y[j - 2] and x[i - 2] == b and a != b:
                best = min(best, prev2[j - 2] + 0.9)
            row.append(best)
        if min(row) > most:
            return math.inf
        prev2, prev = prev, row
    return prev[-1] if prev[-1] <= most else math.inf


def kind_of(kind: str | None) -> str | None:
    return KINDS.get(re.sub(r"[^a-z]", "", (kind or "").lower()))


def guessed_kind(text: str, tokens: list[str], lexicon: Lexicon) -> str:
    """The kind of a name without a type, from the words that go with kinds."""
    said = set(tokens)
    if said & {"project", "prj", "proj", "programme"}:
        return "project"
    if said & {"rv", "vessel"}:
        return "vessel"
    if said & set(lexicon.full.get("org", ())) or any(len(t) > 6 and lexicon.near_word("org", t) for t in tokens):
        return "org"
    if said & set(lexicon.full.get("place", ())) or any(len(t) > 4 and lexicon.near_word("place", t) for t in tokens):
        return "place"
    short = len(tokens) == 2 and len(tokens[0]) > 5 and tokens[-1].isalpha()
    if short and (len(tokens[-1]) == 3 or len(tokens[-1]) == 2 and text.rstrip().endswith(".")) and lexicon.qualifier("place", tokens[-1]):
        return "place"
    if short and len(tokens[-1]) == 2 or re.search(r"\b[a-z]\. ?[a-z]\.$", text) and len(tokens) == 3 and len(tokens[0]) > 5:
        return "org"
    return "person"


def read_name(name: str, kind: str | None, lexicon: Lexicon) -> tuple[str, str, str, str, str]:
    """(kind, core, first, second, number). first and second: given name (or 'x.' for an initial) and nothing; a kind of place and nothing; the two words of an organisation ('x.' for initials). Several words in one of them are alternatives."""
    text = fold(name)
    tokens = re.findall(r"[a-z]+|\d+", text)
    kind = kind_of(kind) or guessed_kind(text, tokens, lexicon)
    number, words = "", []
    for k, t in enumerate(tokens):
        if t.isdigit():
            number = str(int(t))
        elif kind in ("project", "vessel") and t in ROMAN and k:
            number = str(ROMAN[t])
        elif t not in DROPPED:
            words.append(t)
    first = second = ""
    if kind in ("place", "org"):
        number, words, first, second = "", *_qualified(words, kind, lexicon)
    elif kind == "person":
        rest = [t for t in words if len(t) > 1]
        letters = [t for t in words if len(t) == 1]
        if len(rest) > 1:
            comma = "," in text
            stands = len(rest) - 1 if comma else 0
            odds = [lexicon.givenness(t, k == stands) + (1.0 if k == stands else 0.0) for k, t in enumerate(rest)]
            k = max(range(len(rest)), key=lambda k: (odds[k], k == stands))
            first = lexicon.given_name(rest.pop(k))
        elif letters:
            first = letters[0] + "."
        words = rest
    core = max(words, key=len) if words else ""
    if kind == "person" and len(words) > 1:
        core = "".join(words)
    return kind, core, first, second, number


def _qualified(words: list[str], kind: str, lexicon: Lexicon) -> tuple[list[str], str, str]:
    """(other words, first, second) of an organisation or place. At least one word stays: the one that is no qualifier, else the longest."""
    rest, letters, got = [], [], {"first": "", "second": ""}
    found = [(t, lexicon.qualifier(kind, t) if len(t) > 1 else None) for t in words]
    if found and all(q or len(t) == 1 for t, q in found):
        spared = max(found, key=lambda x: len(x[0]))
        found = [(t, None if (t, q) is spared or (t, q) == spared else q) for t, q in found]
    for t, q in found:
        side = lexicon.side(kind, q) if q else ""
        if q and not got[side]:
            got[side] = q
        elif len(t) == 1 and kind == "org":
            letters.append(t)
        else:
            rest.append(t)
    out = []
    for t in rest:  # words that ran together
        tail = next((w for k in range(len(t) - 4, 3, -1) if (w := t[k:]) in lexicon.whole.get(kind, ()) and not got[lexicon.side(kind, w)]), None)
        if tail:
            got[lexicon.side(kind, tail)], t = tail, t[: -len(tail)]
        out.append(t)
    if kind == "org" and not any(got.values()):
        pair = next((t for t in out if len(t) == 2), None)
        if len(out) > 1 and pair:
            letters, out = list(pair), [t for t in out if t != pair]
        if len(letters) >= 2:
            got = {"first": letters[0] + ".", "second": letters[1] + "."}
    return out, got["first"], got["second"]


def learned_lexicon(entities: DataFrame) -> Lexicon:
    """The lexicon of the corpus, from all rows (name, type) whose type is known.

    What reaches the driver: words beside at least `LEAST_BESIDE` rarer words, and beside a share of all names; so their
    number is bounded by the words of a name over that share.
    """
    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, n, t in zip(b["entity_id"], b["name"], b["type"]):
                kind = kind_of(t if isinstance(t, str) else None)
                if kind in ("org", "place", "person") and isinstance(n, str):
                    text = fold(n)
                    ts = [w for w in re.findall(r"[a-z]+", text) if len(w) > 1 and w not in DROPPED]
                    stands = len(ts) - 1 if "," in text else 0
                    for k, w in enumerate(ts):
                        rows.append((i, kind, w, k == stands, k + 1 == len(ts) and "," not in text, len(ts)))
            yield pd.DataFrame(rows, columns=["entity_id", "kind", "w", "given", "last", "size"])

    rows = cut(entities.mapInPandas(words, f"entity_id {dict(entities.dtypes)['entity_id']}, kind string, w string, given boolean, last boolean, size int"))
    n = rows.select("entity_id").distinct().count()
    floor = max(LEAST_BESIDE, int(n * SHARE))
    counts = rows.where("kind <> 'person'").groupBy("kind", "w").agg(F.count(F.lit(1)).alias("n"))
    seen = rows.where("size > 1").join(counts, ["kind", "w"])
    rarest = seen.groupBy("entity_id", "kind").agg(F.min(F.struct("n", (-F.length("w")).alias("len"), "w")).alias("r")).select("entity_id", "kind", F.col("r.w").alias("core"))
    beside = seen.join(rarest, ["entity_id", "kind"]).where("w <> core").groupBy("kind", "w", "core").agg(F.max(F.col("last").cast("int")).alias("last"))
    top = beside.groupBy("kind", "w").agg(F.count(F.lit(1)).alias("n"), F.avg("last").alias("last")).where(F.col("n") >= floor).collect()
    qualifiers: dict[str, list[tuple[str, int, float]]] = {}
    for r in sorted(top, key=lambda r: (r["kind"], -r["n"], r["w"])):
        qualifiers.setdefault(r["kind"], []).append((r["w"], r["n"], r["last"]))
    sides = rows.where("kind = 'person' and size > 1").groupBy("w").agg(F.sum(F.col("given").cast("int")).alias("g"), F.sum((~F.col("given")).cast("int")).alias("s"))
    given = {r["w"]: (r["g"], r["s"]) for r in sides.where((F.col("g") >= 2) & (F.col("g") >= int(n * SHARE))).collect()}
    return Lexicon(qualifiers, given)


#: Keys of a core: itself without up to two of its letters, and the set of its letters. Any two cores within `MOST` have one
#: in common: that cost allows two errors of any sort, so that the rest is the same without two letters each; or three that
#: each swap or double letters (0.9), which leaves the set of letters as it is.
NEAR_KEYS = """concat(
    array(core, concat('=', array_join(array_sort(array_distinct(split(core, ''))), ''))),
    transform(sequence(1, length(core)), i -> concat(substring(core, 1, i - 1), substring(core, i + 1))),
    if(length(core) < 2, array(), flatten(transform(sequence(1, length(core) - 1), i -> transform(sequence(i + 1, length(core)),
        j -> concat(substring(core, 1, i - 1), substring(core, i + 1, j - i - 1), substring(core, j + 1)))))))"""


def near_cores(kinds: DataFrame) -> DataFrame:
    """Rows (kind, centre, core): for every core (kind, core) those that share a key with it, itself included.

    Cores are letters a to z, so how many share a key is bounded by the words that two more letters make of it.
    """
    ids = kinds.select("kind", "core", F.xxhash64("kind", "core").alias("c"))
    # few bytes become many keys: not to be coalesced into one task
    width = int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = ids.repartition(width, "c").select("c", F.explode(F.expr(f"array_distinct(transform({NEAR_KEYS}, k -> xxhash64(kind, k)))")).alias("key"))
    groups = keyed.groupBy("key").agg(F.collect_set("c").alias("met")).where("size(met) > 1").select("met")
    met = groups.select(F.explode("met").alias("c"), "met").select("c", F.explode("met").alias("o")).where("c <> o").distinct()
    both = met.join(ids.select("kind", F.col("core").alias("centre"), "c"), "c").join(ids.select("core", F.col("c").alias("o")), "o")
    return both.select("kind", "centre", "core").unionByName(kinds.select("kind", F.col("core").alias("centre"), "core"))


def qualifier_cost(kind: str, x: tuple[str, str, str], y: tuple[str, str, str]) -> float:
    """How unlikely x's qualifiers are for something that is fully called y; infinite where they contradict."""
    (xf, xs, xn), (yf, ys, yn) = x, y
    if xn != yn:
        return math.inf
    if kind == "person":
        if xf == yf:
            return 0.0
        if not xf:
            return 2.0
        if not yf:
            return math.inf
        if xf.endswith("."):
            return 1.0 if any(g[0] == xf[0] for g in yf.split()) else math.inf
        if yf.endswith("."):
            return math.inf
        if set(xf.split()) & set(yf.split()):
            return 0.3
        return 3.0 if one_edit(xf, yf) and len(xf) > 3 else math.inf
    if kind == "org":
        if (xf, xs) == (yf, ys):
            return 0.0
        if not yf or not ys or yf.endswith("."):
            return math.inf
        if xf.endswith("."):
            return 1.0 if any(w[0] == xf[0] for w in yf.split()) and any(w[0] == xs[0] for w in ys.split()) else math.inf
        if xf and not set(xf.split()) & set(yf.split()) or xs and not set(xs.split()) & set(ys.split()):
            return math.inf
        return (0.3 if xf and xs else 1.5 if xf or xs else 3.0) + 0.3 * (yf.count(" ") + ys.count(" "))
    return 0.0 if (xf, xs) == (yf, ys) else 0.3 if set(xf.split()) & set(yf.split()) else math.inf


def _full(kind: str, first: str, second: str) -> bool:
    """The reading names its thing fully: no initials, no alternatives, nothing left out."""
    if kind == "person":
        return bool(first) and not first.endswith(".")
    return " " not in first + second and (kind != "org" or bool(first and second) and not first.endswith("."))


def _neighbours(block: list[tuple], centre: str) -> list[tuple]:
    """(sid, how many spellings one typing error turns into it) for the spellings whose core is `centre`."""
    near = [y for y in block if y[2] != centre and one_edit(centre, y[2])]
    out = []
    for x in block:
        if x[2] == centre:
            n = sum(min(qualifier_cost(x[1], x[3:6], y[3:6]), qualifier_cost(x[1], y[3:6], x[3:6])) <= 0.3 for y in near)
            if n:
                out.append((x[0], n))
    return out


def _attached(block: list[tuple], centre: str) -> list[tuple]:
    """The best attachment of each spelling whose core is `centre`: (sid, parent, ambiguous). A row is (sid, kind, core, first, second, number, n, freq, odd, rank, degree)."""
    block.sort(key=lambda r: (-r[9], r[0]))
    costs = {core: typing_cost(centre, core, MOST) for core in {r[2] for r in block}}
    block = [r for r in block if costs[r[2]] < math.inf]
    out = []
    for k in range(1, len(block)):
        x = block[k]
        if x[2] != centre:
            continue
        quals, best, rival = (x[3], x[4], x[5]), None, -math.inf
        for y in block[:k]:
            q = qualifier_cost(x[1], quals, (y[3], y[4], y[5]))
            if q == math.inf:
                continue
            c = costs[y[2]]
            s = math.log(y[6] + y[10] + 0.2 * math.log1p(y[7])) - 3.0 * c - q
            own = 4.5 * math.log(x[6]) - (7.5 if x[8] else 5.0 if x[1] in ("person", "org") else 4.2) - (0.0 if _full(x[1], x[3], x[4]) else 2.0)
            if c > 0 and s <= own:
                continue
            if best is None or s > best[1]:
                if best is not None and qualifier_cost(x[1], best[2], (y[3], y[4], y[5])) == math.inf == qualifier_cost(x[1], (y[3], y[4], y[5]), best[2]):
                    rival = max(rival, best[1])
                best = (y[0], s, (y[3], y[4], y[5]))
            elif qualifier_cost(x[1], (y[3], y[4], y[5]), best[2]) == math.inf == qualifier_cost(x[1], best[2], (y[3], y[4], y[5])):
                rival = max(rival, s)
        if best:
            out.append((x[0], best[0], rival > best[1] - 0.9))
    return out


def link_variants(entities: DataFrame) -> DataFrame:
    """Rows (entity_id, root): entities with the same root name the same thing; one row per entity_id.

    `entities` has entity_id, name, type and frequency. Null and blank names, and names without a letter, have their own
    entity_id as root. Repeated rows count once; null types are inferred from the name; null frequencies count as 0. Ties
    go to the more frequent, then the alphabetically first spelling. A reference that fits two different full names
    about equally well is left alone. Extra columns are ignored.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, n, t, f in zip(b["entity_id"], b["name"], b["type"], b["frequency"]):
                kind, core, first, second, number = read_name(n, t if isinstance(t, str) else None, lexicon) if isinstance(n, str) else ("", "", "", "", "")
                sid = f"{kind}|{core}|{first}|{second}|{number}" if core else f"#{i}"
                rows.append((i, sid, kind, core, first, second, number, int(f) if f == f and f is not None else 0))
            yield pd.DataFrame(rows, columns=["entity_id", "sid", "kind", "core", "first", "second", "number", "freq"])

    distinct = entities.where("entity_id is not null").groupBy("entity_id").agg(F.min("name").alias("name"), F.min("type").alias("type"), F.max("frequency").alias("frequency"))
    distinct = cut(distinct)
    lexicon = learned_lexicon(distinct)
    readings = cut(distinct.mapInPandas(read, "entity_id bigint, sid string, kind string, core string, first string, second string, number string, freq bigint"))
    spellings = readings.where("core <> ''").groupBy("sid", "kind", "core", "first", "second", "number").agg(F.count(F.lit(1)).alias("n"), F.sum("freq").alias("freq"))

    # letter triples of all cores: at most 28 cubed rows, whatever the corpus
    def triples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = Counter(t for w in b["core"] for t in {f"^{w}$"[k : k + 3] for k in range(len(w))})
            yield pd.DataFrame(list(c.items()), columns=["t", "n"])

    cores = spellings.select("core").distinct()
    known = {r["t"]: r["n"] for r in cores.mapInPandas(triples, "t string, n bigint").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    usual = sum(known.values()) / max(1, len(known)) / 12 if known else 0.0

    near = cut(near_cores(spellings.select("kind", "core").distinct()))

    def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sid, kind, core, first, second, number, n, freq, degree in b.itertuples(index=False, name=None):
                odd = min(known.get(f"^{core}$"[k : k + 3], 0) for k in range(len(core))) < usual
                rank = 2 * FULL * _full(kind, first, second) + 10 * math.log(n + degree) + math.log1p(freq) - 8 * odd
                rows.append((sid, kind, core, first, second, number, n, freq, odd, rank, degree))
            yield pd.DataFrame(rows, columns=columns)

    schema = "sid string, kind string, core string, first string, second string, number string, n bigint, freq bigint, odd boolean, rank double, degree bigint"
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def over_blocks(step, columns: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, block = None, []
            for b in batches:
                out = []
                for kind, centre, *row in b.itertuples(index=False, name=None):
                    if (kind, centre) != key:
                        if len(block) > 1:
                            out.extend(step(block, key[1]))
                        key, block = (kind, centre), []
                    block.append((row[0], kind, *row[1:]))
                yield pd.DataFrame(out, columns=columns)
            yield pd.DataFrame(step(block, key[1]) if len(block) > 1 else [], columns=columns)

        return run

    def blocks(rows: DataFrame) -> DataFrame:
        """For each core, its spellings and those of the cores near it."""
        around = near.join(rows, ["kind", "core"]).select("kind", "centre", "sid", *[c for c in rows.columns if c not in ("sid", "kind")])
        return around.repartition("kind", "centre").sortWithinPartitions("kind", "centre")

    degrees = blocks(spellings.select(*columns[:6])).mapInPandas(over_blocks(_neighbours, ["sid", "degree"]), "sid string, degree bigint")
    ranked = spellings.join(degrees, "sid", "left").fillna(0, ["degree"]).select(*columns[:8], "degree").mapInPandas(ranks, schema)
    links = blocks(ranked).mapInPandas(over_blocks(_attached, ["sid", "root", "ambiguous"]), "sid string, root string, ambiguous boolean")
    parents = cut(links.where("not ambiguous").select("sid", "root"))
    while True:  # pointer jumping: attachments lead up in rank, so there are no cycles and each round halves the depth
        up = parents.select(F.col("sid").alias("root"), F.col("root").alias("above"))
        jumped = cut(parents.join(up, "root", "left").select("sid", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        parents = jumped.select("sid", "root")
        if jumped.where("moved").isEmpty():
            break
    return readings.select("entity_id", "sid").join(parents, "sid", "left").select("entity_id", F.coalesce("root", "sid").alias("root"))


def linked_pairs(links: DataFrame) -> DataFrame:
    """Every pair (entity_id_a < entity_id_b) of entities with the same root; the result is all pairs by definition."""
    a = links.select("root", F.col("entity_id").alias("entity_id_a"))
    b = links.select("root", F.col("entity_id").alias("entity_id_b"))
    return a.join(b, "root").where("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b")
