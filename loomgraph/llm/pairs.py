"""Broken prompt and response pairs: empty, truncated, refusing, copying and foreign-language answers.

One pass over the pairs applies, in this order: a test for answers without content, refusal automata (Aho-Corasick over
normalised text, quotations left out), a suffix automaton of the question that measures how much of the answer is copied
from it, votes of stop words for the languages of question and answer, and a stack of delimiters with the marks of a text
that breaks off. Answers that merely lack the last stop are then compared with how sentences end in the whole corpus:
the last words (names and numbers masked) must be seen before a stop often enough, else the answer was broken off.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut

# Function words of published stop word lists, without those that several of the languages write alike.
STOPWORDS = {
    "en": "the of and to in that is was for it with as his on be at by had not are but from or have an they which one were all her she there would their him been has when who will no more if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over me even most made after also did many off before must well back through years much where your way down should because each just those how too own while here between both under last never against without during since yet still until".split(),
    "fr": "le la les de des du et en un une dans que qui est pour pas sur au aux avec par ce cette ces il elle ils elles nous vous je sont ont été était étaient mais ou où donc car ne plus son sa ses leur leurs à se si tout tous toute toutes même aussi après avant depuis sans sous entre encore très peu être avoir fait dont quand comme chez vers jamais toujours rien quelle quel quelles combien pourquoi d'un d'une c'est n'a qu'il maintenant eux lui notre votre parce".split(),
    "de": "der die das und ist von zu mit den dem des im in ein eine einer eines einem einen nicht auf für als auch es an werden aus er hat dass daß sie nach wird bei noch wie über so zum zur war haben nur oder aber vor bis mehr durch man sein wurde sind ihre ihr seine seit unter kann gegen vom wenn schon sich ob weil doch dann keine kein wer wann warum welche welcher diese dieser dieses jetzt wieder sehr obwohl davon denen während ohne konnte können hatte hatten wurden waren zwischen".split(),
    "es": "el la los las de del y en un una que es por con para no se su sus al lo como más pero le ya o este esta estos estas sí porque entre cuando muy sin sobre ser también me hasta hay donde quien quién desde todo nos durante todos uno les ni contra otros ese eso había ante ellos e antes unos yo otro otras otra él tanto esa mucho nada muchos cual cuál cuándo cuántas cuántos poco ella estas fue son ha han era aunque después dónde qué ahora".split(),
    "pt": "o os um uma do da dos das em no na nos nas ao aos à às não que com por para mais foi são seu sua seus suas ele ela eles elas mas porque quando muito também já até pelo pela pelos pelas desde sem depois você isso isto este esta esse essa estes estas esses essas foram está estão ainda num numa nem era eram tem têm tinha ter lhe lhes só quem qual e".split(),
    "it": "il lo gli i di del dello dei delle degli dell nel nello nella nei nelle negli e è un una che non per con sono da al allo alla agli alle ai più come ma anche questo questa questi queste quello quella dal dallo dalla dai dalle sul sulla sua suo suoi sue loro si ha hanno era erano dopo prima quando perché senza fino molto tutto tutti stato stata cui dove chi tra fra".split(),
    "nl": "de het een en van ik te dat die in is niet zijn op aan met als voor had er maar om hem dan zou of wat mijn men dit zo door over ze zich bij ook tot je mij uit der daar haar naar heb hoe heeft hebben deze want nog zal zij nu geen omdat iets worden toch waren veel meer doen toen moet ben zonder kan hun dus alles onder eens werd altijd doch wordt kunnen ons zelf tegen reeds kon niets uw iemand geweest andere".split(),
    "sv": "och det att i en jag hon som han på den med var sig för så till är men ett om hade de av icke mig du henne då sin nu har inte hans honom skulle hennes där min man ej vid kunde något från ut när efter upp vi dem vara vad över än dig kan sina här alla någon eller allt mycket sedan ju denna själv detta åt utan varit hur ingen mitt ni bli blev oss dessa några deras blir mina vilken sådan vår blivit dess inom mellan".split(),
    "da": "og i jeg det at en den til er som på de med han af for ikke der var mig sig men et har om vi min havde ham hun nu over da fra du ud sin dem os op man hans hvor eller hvad skal selv her alle vil blev kunne ind når være dog noget ville jo deres efter ned skulle denne end dette også dig anden hende alt meget sit sine mod disse hvis din nogle hos blive mange ad bliver hendes været".split(),
    "pl": "i w na z do się nie to że jest o po jak za od przez dla ale czy są być był była było były tak już jego jej tym tego tej ten ta który która które których tylko może oraz przed gdy bez pod ponieważ aby jednak między kiedy gdzie jeszcze przy nad bo a ze lecz więc niż albo".split(),
    "tr": "ve bir bu da de için ile olarak çok daha gibi olan sonra kadar ne ama ki o her en var yok değil mi ise çünkü hiç şu şey veya nasıl neden niçin diye bazı tüm önce".split(),
    "fi": "ja on ei se että oli hän ovat mutta kun niin myös kuin sen joka mitä vain jo tai nyt ole olla hänen jos sitä siitä koska eivät olivat ollut jotka tämä tämän niiden mikä vielä sekä".split(),
}

# Letters that one of the languages alone uses; a word with one of them votes like half a stop word.
OWN_LETTERS = {"ł": "pl", "ą": "pl", "ę": "pl", "ś": "pl", "ź": "pl", "ż": "pl", "ć": "pl", "ń": "pl", "ã": "pt", "õ": "pt", "ğ": "tr", "ı": "tr", "ş": "tr", "æ": "da", "ø": "da", "ß": "de", "ñ": "es"}

# Months, which vote like stop words where only one language spells them so.
MONTHS = {
    "en": "january february march may june july october december".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "de": "januar februar märz mai juni juli oktober dezember".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}

_VOTES: dict[str, list[tuple[str, float]]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in {*_words, *MONTHS.get(_lang, ())}:
        _VOTES.setdefault(_w, []).append((_lang, 1.0))

_MONTH_NAMES = {m for ms in MONTHS.values() for m in ms}
_MAIN = ("en", "fr", "de", "es")

# What refusals are made of, by language, after normalisation (lower case, straight quotes, single spaces).
PARTS = {
    "en unable": ["i can't", "i cannot", "i can not", "i could not", "i couldn't", "i am unable", "i'm unable", "i am not able", "i'm not able", "i won't", "i will not", "i am not allowed", "i'm not allowed", "i am not permitted", "i'm not permitted", "i am not comfortable", "i'm not comfortable", "i'd rather not", "i would rather not", "i'd prefer not", "i would prefer not", "we cannot", "we can't", "we are unable", "we're unable", "i do not feel able", "i don't feel able", "i shouldn't", "i should not"],
    "en say": ["help", "answer", "answering", "assist", "provide", "give", "giving", "share", "sharing", "discuss", "discussing", "comment", "commenting", "say", "speculate", "respond", "reply", "disclose", "reveal", "tell", "talk", "talking", "speak", "advise", "fulfil", "fulfill", "comply", "offer", "address", "engage", "go into"],
    "en lack": ["i don't have", "i do not have", "i have no", "i lack", "we don't have", "we do not have", "i haven't", "i was not given", "i wasn't given"],
    "en knowledge": ["access", "information", "data", "knowledge", "records", "details", "enough", "sufficient", "sources", "answer", "basis", "facts"],
    "en what": ["something", "a topic", "a subject", "a matter", "a question", "anything", "what", "outside", "beyond", "those", "things"],
    "en may": ["i am allowed", "i'm allowed", "i am permitted", "i'm permitted", "i am able", "i'm able", "i am authorised", "i'm authorised", "i am authorized", "i'm authorized", "i am free", "i'm free", "i can", "i may"],
    "en not": ["not", "isn't", "nothing", "no", "outside", "beyond", "without"],
    "en for me": ["appropriate for me", "proper for me", "right for me", "possible for me", "let me", "allow me to", "enable me to", "lets me", "allows me to", "enables me to", "permit me to", "help me"],
    "en source": ["context", "passages", "passage", "sources", "documents", "document", "records", "material", "text", "texts", "excerpts"],
    "en silent": ["does not contain", "doesn't contain", "do not contain", "don't contain", "does not include", "do not include", "does not provide", "do not provide", "does not mention", "do not mention", "does not say", "do not say", "contains no", "contain no"],
    "en given": ["no answer can be", "no answer is possible", "cannot be answered", "can't be answered", "can not be answered", "could not be answered", "impossible to answer", "not possible to answer"],
    "fr unable": ["je ne peux", "je ne suis pas en mesure", "je suis dans l'impossibilité", "je ne saurais", "je préfère ne pas", "je refuse", "je dois refuser", "je ne souhaite pas", "je ne suis pas autorisé", "il m'est impossible", "je ne veux pas", "nous ne pouvons", "je dois m'abstenir"],
    "fr say": ["répondre", "aider", "donner", "fournir", "commenter", "m'exprimer", "exprimer", "dire", "partager", "communiquer", "parler", "me prononcer", "discuter", "révéler", "assister", "divulguer"],
    "fr lack": ["je n'ai pas", "je ne dispose pas", "je n'ai aucun", "je ne dispose d'aucun", "ne permet pas de", "ne permettent pas de"],
    "fr knowledge": ["accès", "information", "informations", "données", "éléments", "assez", "suffisamment", "aucune", "répondre"],
    "es unable": ["no puedo", "no me es posible", "no estoy autorizado", "no estoy autorizada", "no estoy en condiciones", "prefiero no", "debo abstenerme", "me niego", "no debo", "no podemos", "no es posible", "no se puede", "no quiero", "no voy a", "tengo que negarme"],
    "es say": ["ayudar", "ayudarle", "ayudarte", "responder", "responderle", "contestar", "dar", "proporcionar", "facilitar", "comentar", "decir", "decirle", "compartir", "hablar", "pronunciarme", "revelar", "opinar", "ofrecer"],
    "es lack": ["no tengo", "no dispongo", "carezco", "no contiene", "no contienen", "no cuento con"],
    "es knowledge": ["acceso", "información", "datos", "suficiente", "suficientes", "elementos", "respuesta"],
    "de unable": ["kann ich", "ich kann", "darf ich", "ich darf", "möchte ich", "ich möchte", "ich bin nicht in der lage", "ich bin nicht befugt", "ich muss es ablehnen", "ich muss ablehnen", "ich werde", "werde ich", "können wir", "wir können"],
    "de not": ["nicht", "keine", "keinen", "nichts", "leider"],
    "de say": ["beantworten", "helfen", "antworten", "auskunft", "äußern", "sagen", "mitteilen", "geben", "sprechen", "teilen", "weitergeben", "stellung nehmen", "kommentieren", "besprechen", "verraten", "machen"],
    "de lack": ["liegen mir", "ich habe", "habe ich", "mir fehlen", "mir fehlt"],
    "de knowledge": ["informationen", "daten", "zugriff", "angaben", "zugang", "unterlagen", "auskunft", "kenntnis"],
}

#: Refusals as parts that follow each other, with so many characters in between at most.
FORMS = [
    ("en unable", "en say"), ("en lack", "en knowledge"), ("en knowledge", "en lack"), ("en not", "en what", "en may", "en say"), ("en what", "en may", "en say"), ("en not", "en for me", "en say"),
    ("en source", "en silent", "en knowledge"), ("en given",), ("fr unable", "fr say"), ("fr lack", "fr knowledge"), ("es unable", "es say"), ("es lack", "es knowledge"),
    ("de unable", "de not", "de say"), ("de lack", "de not", "de knowledge"),
]
BETWEEN = 40

# What refuses by itself.
REFUSALS = [
    "i must refrain", "i must decline", "i have to decline", "i have to refuse", "i decline to", "i refuse to", "i don't know", "i do not know", "against my guidelines", "against my instructions", "as an ai", "as a language model",
    "i'm sorry, but i", "i am sorry, but i", "sorry, i can't", "sorry, i cannot", "unfortunately, i can't", "unfortunately, i cannot",
    "je suis désolé, mais je", "je suis désolée, mais je", "je ne sais pas", "je regrette, mais",
    "lo siento, pero", "lo siento, no", "no sé la respuesta",
    "es tut mir leid", "tut mir leid, aber", "ich weiß es nicht", "lässt sich nicht beantworten", "mir fehlen die informationen",
]

# Answers that say nothing, without case, outer white space and punctuation.
PLACEHOLDERS = {
    "", "na", "n a", "null", "none", "nil", "nan", "blank", "empty", "tbd", "tba", "todo", "to do", "undefined", "placeholder", "missing", "unknown", "xxx", "no answer", "no response", "not available", "lorem ipsum",
    "answer", "final answer", "the answer", "a", "response", "réponse", "respuesta", "antwort", "output", "result", "réponse finale", "respuesta final", "sin respuesta", "keine antwort", "sans réponse", "pending", "insert answer here", "your answer here",
}

#: Share of an answer that must stand in the question.
COPIED = 0.8

_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“”]*[“”]|‹[^›]*›")
_LABEL = re.compile(r"^\s*[\W_]*(final answer|the answer is|the answer|answer|response|réponse finale|réponse|respuesta final|respuesta|antwort|a|r|output)\s*[:：\-–—]+[\W_]*$", re.I)
_END = re.compile(r"[.!?。！？؟;]$|[.!?][\"'»”’)\]]+$")
_FADES = re.compile(r"(\.\.\.|…|\[\s*(…|\.\.\.|cut|truncated)\s*\])[\"'»”’)\]*_\s]*$")
_TITLES = {"dr.", "mr.", "mrs.", "ms.", "prof.", "capt.", "st.", "e.g.", "i.e.", "approx.", "p.", "z.b.", "sr.", "sra.", "mme.", "m.", "bzw."}
_LIST = re.compile(r"^\s*(\d+[.)]|[-*•–])(\s+\S|$)")
_FORMAT = regex.compile(r"\p{Cf}+")
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_OTHER = re.compile(r"[\W_]+")
_SENTENCE_END = re.compile(r"[.!?;] ")
_LETTER, _LATIN = regex.compile(r"\p{L}"), regex.compile(r"\p{Latin}")


@lru_cache(maxsize=1024)
def plain(text: str) -> str:
    """Without emphasis marks, zero-width characters and outer white space."""
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKC", text))
    return re.sub(r"\*\*|__|`+|^#+\s+", "", text).strip().strip("*").strip()


def squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text.lower().replace("’", "'").replace("ʼ", "'"))


def says_nothing(text: str | None) -> bool:
    if text is None or _LABEL.match(text):
        return True
    words = _OTHER.sub(" ", plain(text).lower()).split()
    return " ".join(words) in PLACEHOLDERS or "".join(words) in ("na", "nil") or not words


class SuffixAutomaton:
    """The suffix automaton of a text, for the longest match that ends at each place of another."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for ch in text:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][ch]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(ch) == q:
                        self.next[p][ch] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def coverage(self, text: str, least: int) -> int:
        """How many characters of `text` lie in a match of at least `least` characters."""
        state = size = covered = until = 0
        for k, ch in enumerate(text):
            while state and ch not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if ch in self.next[state]:
                state, size = self.next[state][ch], size + 1
            else:
                size = 0
            if size >= least:
                start = max(until, k + 1 - size)
                covered += k + 1 - start
                until = k + 1
        return covered


def _letters(text: str) -> str:
    return " ".join(_WORD.findall(squeezed(text)))


def copied(question: str, answer: str, least: int = 4) -> tuple[float, float]:
    """Shares of the answer that stand in the question, and of the question that stand in the answer."""
    q, a = _letters(question), _letters(answer)
    if not q or not a:
        return 0.0, 0.0
    # whoever lies in a match of `least` characters lies in a common gram: too few of those settle it without the automata
    grams = {q[k : k + least] for k in range(len(q) - least + 1)}
    covered = until = 0
    for k in range(len(a) - least + 1):
        if a[k : k + least] in grams:
            covered += k + least - max(k, until)
            until = k + least
    if covered < COPIED * len(a):
        return covered / len(a), 0.0
    return SuffixAutomaton(q).coverage(a, least) / len(a), SuffixAutomaton(a).coverage(q, least) / len(q)


def is_copy(question: str, answer: str) -> bool:
    """The answer only repeats the question, perhaps with slight changes: each covers nearly all of the other."""
    of_answer, of_question = copied(question, answer)
    return of_answer >= COPIED and of_question >= 0.75


def _foreign_script(text: str) -> bool:
    """Most letters are not Latin ones."""
    letters = len(_LETTER.findall(text))
    return letters > 0 and len(_LATIN.findall(text)) < 0.5 * letters


def language_votes(text: str, lexicon: dict[str, list[tuple[str, float]]] | None = None) -> tuple[Counter, int]:
    """Votes per language and the number of voting words. Quotations and capitalised words inside a sentence do not vote."""
    text = _QUOTED.sub(" ", plain(text).replace("’", "'"))
    votes: Counter = Counter()
    tokens = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?¿:]", text)
    start, cast = True, 0
    for k, t in enumerate(tokens):
        if t in ".!?¿:":
            start = True
            continue
        named = t[0].isupper()
        low = t.lower()
        inside = 0 < k < len(tokens) - 1 and tokens[k - 1][0].isupper() and tokens[k + 1][0].isupper() and low == "of"
        if low in _MONTH_NAMES or not inside and (not named or start):
            own = _VOTES.get(low)
            if own is None and "'" in low:
                own = _VOTES.get(low.split("'")[1]) or ([("fr", 1.0)] if low.split("'")[0] in ("l", "d", "qu", "n", "s", "j") else None)
            if own is None and not named and not low.isascii():
                own = [(g, 0.5) for g in {OWN_LETTERS[c] for c in low if c in OWN_LETTERS}] or None
            if own is None and lexicon is not None:
                own = lexicon.get(low)
            elif own is not None and len(own) > 1:
                own = [(g, 0.4) for g, _ in own]
            for g, v in own or ():
                votes[g] += v
                cast += 1
        elif lexicon is not None and low in lexicon:
            for g, v in lexicon[low]:
                votes[g] += v
                cast += 1
        start = False
    return votes, cast


@lru_cache(maxsize=4096)
def question_language(question: str | None) -> str | None:
    """The language with the most votes; None where none leads."""
    if not question:
        return None
    votes, _ = language_votes(question)
    best = votes.most_common(2)
    if not best or len(best) > 1 and best[0][1] - best[1][1] < 0.3:
        return "es" if "¿" in question else best[0][0] if best and best[0][1] >= 1 and best[0][0] == "en" else None
    return best[0][0]


def other_language(question: str, answer: str, lexicon: dict) -> bool:
    asked = question_language(question)
    if asked is None:
        return False
    if not answer.isascii() and _foreign_script(_QUOTED.sub(" ", answer)) and not _foreign_script(question):
        return True
    votes, _ = language_votes(answer, lexicon)
    mine = votes.pop(asked, 0.0)
    best = votes.most_common(1)
    # the four languages of the corpus need one sure vote, others more: their short words are also parts of names
    return bool(best) and best[0][1] >= (0.9 if best[0][0] in _MAIN else 2.5) and best[0][1] >= 2 * mine + (0.6 if mine else 0)


def unclosed(text: str) -> bool:
    """A bracket or quotation mark is still open at the end."""
    pairs = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“„", "“": "„", "›": "‹"}
    stack: list[str] = []
    for ch in text:
        if ch in pairs and stack and stack[-1] in pairs[ch]:
            stack.pop()
        elif ch in "([{«“„‹":
            stack.append(ch)
        elif ch == '"':
            if stack and stack[-1] == '"':
                stack.pop()
            else:
                stack.append(ch)
    return bool(stack)


def masked(text: str, common: frozenset[str]) -> list[str]:
    """The text's words: common ones as they are, runs of names as one '#', numbers as '0', sentence ends as '.'.

    A word is a name if it isn't common in lower case, or is capitalised inside a sentence.
    """
    out: list[str] = []
    for t in re.findall(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*\.?|\d+(?:[.,/]\d+)*|[.!?]+|[,;:()]", text):
        if t[0] in ".!?":
            out.append(".")
        elif t[0] in ",;:()":
            out.append(t)
        elif t[0].isdigit():
            out.append("0")
        else:
            stop = t.endswith(".")
            w = t.rstrip(".").lower()
            short = stop and (w + "." in _TITLES or len(w) == 1)
            if w in common and (t[0].islower() or not out or out[-1] == "."):
                out.append(w)
            elif not out or out[-1] != "#":
                out.append("#")
            if stop and not short:
                out.append(".")
    return out


#: Answers of up to so many words are also compared whole.
WHOLE = 12


def _grams(words: list[str], k: int) -> list[str]:
    """The whole start of a short answer, and its last four to one words."""
    whole = ["^ " + " ".join(words[: k + 1])] if k < WHOLE else [""]
    return whole + [" ".join(words[max(0, k - n + 1) : k + 1]) for n in (4, 3, 2, 1)]


def ending_counts(answers: Iterator[str], common: frozenset[str]) -> tuple[Counter, Counter]:
    """(seen, ends) of every run of up to four words, and of every start as a whole: how often, and how often before a stop."""
    seen: Counter = Counter()
    ends: Counter = Counter()
    for a in answers:
        words = masked(plain(a), common)
        n = len(words)
        last = [k for k in range(n) if words[k] != "." and (k + 1 == n or words[k + 1] == ".")]
        inside = n if n <= 8 and "." not in words else n - 1  # the last word counts only in short answers that need no stop
        runs = words
        for size in range(1, 5):
            if size > 1:
                runs = [f"{x} {y}" for x, y in zip(runs, words[size - 1 :])]
            seen.update(runs[k] for k in range(inside - size + 1) if words[k + size - 1] != ".")
            ends.update(runs[k - size + 1] for k in last if size - 1 <= k < inside)
        start = "^"
        for k in range(min(n, WHOLE)):
            start = f"{start} {words[k]}"
            if words[k] != ".":
                seen[start] += 1
                if k + 1 == n or words[k + 1] == ".":
                    ends[start] += 1
    return seen, ends


def breaks_off(text: str) -> bool | None:
    """True: it surely breaks off; False: it surely does not; None: only its last words can tell."""
    t = plain(text)
    if _FADES.search(t) or unclosed(t):
        return True
    if t[-1] in ",:(-–—/&+«“‹¿[{" or t.endswith((" -", " –")):
        return True
    words = t.split()
    if _END.search(t):
        return len(words) > 4 and words[-1].lower() in _TITLES and words[-1].lower() not in ("st.", "p.", "m.")
    lines = [x for x in t.splitlines() if x.strip()]
    if len(lines) > 1 and all(_LIST.match(x) for x in lines):
        return bool(re.fullmatch(r"\s*(\d+[.)]|[-*•–])\s*", lines[-1]))
    if len(words) < 5 or t[-1] in ")]»”\"'":
        return False
    return None


@lru_cache(maxsize=1)
def _automaton():
    """The parts and whole refusals as one automaton, and for each form the parts it consists of."""
    import ahocorasick

    a = ahocorasick.Automaton()
    found: dict[str, list[str]] = {}
    for part, phrases in [*PARTS.items(), ("refusal", REFUSALS)]:
        for p in phrases:
            found.setdefault(p, []).append(part)
    for p, parts in found.items():
        a.add_word(p, (len(p), tuple(parts)))
    a.make_automaton()
    return a


def refuses(text: str) -> bool:
    """Whole refusals, or parts in the order of a form within one sentence. What stands in quotation marks does not count."""
    t = squeezed(_QUOTED.sub(" ", plain(text).replace("’", "'")))
    reached: dict[tuple[int, int], int] = {}  # (form, parts seen) -> where the last of them ended
    for end, (size, parts) in _automaton().iter(t):
        lo = end + 1 - size
        if lo and (t[lo - 1].isalnum() or t[lo - 1] == "'") or end + 1 < len(t) and t[end + 1].isalnum():
            continue
        for part in parts:
            if part == "refusal":
                return True
            for f, form in enumerate(FORMS):
                for k in range(len(form) - 1, -1, -1):
                    if form[k] != part:
                        continue
                    before = reached.get((f, k))
                    if k and (before is None or before > lo or lo - before > BETWEEN or _SENTENCE_END.search(t, before, lo)):
                        continue
                    if k + 1 == len(form):
                        return True
                    reached[f, k + 1] = end + 1
    return False


def defect_of(question: str | None, answer: str | None, lexicon: dict) -> str:
    """A defect, '' for none, or 'open' where the ends of all sentences must decide."""
    if says_nothing(answer):
        return "empty"
    if question and is_copy(question, plain(answer)):
        return "copy"
    if refuses(answer):
        return "refusal"
    if question and other_language(question, answer, lexicon):
        return "language"
    off = breaks_off(answer)
    return "truncated" if off else "open" if off is None else ""


def common_words(answers: DataFrame, share: float = 1 / 4000, least: int = 3) -> list[str]:
    """Words in at least that share of the answers, mostly in lower case. Their number is bounded by words per answer over the share, whatever the corpus."""
    n = answers.count()
    floor = max(least, int(n * share))
    words = answers.select(F.explode(F.array_distinct(F.expr(r"regexp_extract_all(answer, '\\p{L}+(?:[''’\\-]\\p{L}+)*', 0)"))).alias("w"))
    counted = words.groupBy(F.lower("w").alias("low")).agg(F.sum(F.when(F.col("w") == F.lower("w"), 1).otherwise(0)).alias("small"), F.count(F.lit(1)).alias("n"))
    return [r["low"] for r in counted.where((F.col("n") >= floor) & (F.col("small") >= 0.5 * F.col("n"))).select("low").collect()]


def learned_lexicon(pairs: DataFrame, common: list[str], sure: float = 0.85, least: int = 5) -> dict[str, list[tuple[str, float]]]:
    """Words that are no stop words but stand almost only in answers to questions of one language."""
    keep = frozenset(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter = Counter()
            for q, a in zip(b["question"], b["answer"]):
                g = question_language(q)
                if g and a:
                    c.update((w, g) for w in set(re.findall(r"[^\W\d_]+", _QUOTED.sub(" ", a).lower())) if w in keep)
            yield pd.DataFrame([(w, g, n) for (w, g), n in c.items()], columns=["w", "g", "n"])

    counts = pairs.select("question", "answer").mapInPandas(run, "w string, g string, n bigint").groupBy("w", "g").agg(F.sum("n").alias("n"))
    by: dict[str, Counter] = {}
    total: Counter = Counter()
    for r in counts.collect():  # at most `common` words times languages
        by.setdefault(r["w"], Counter())[r["g"]] += r["n"]
        total[r["g"]] += r["n"]
    out: dict[str, list[tuple[str, float]]] = {}
    for w, c in by.items():
        # English makes up most of the corpus: counts are compared as shares of their language's own words
        rates = {g: n / total[g] for g, n in c.items()}
        g, top = max(rates.items(), key=lambda x: x[1])
        if w not in _VOTES and c[g] >= (least if g != "en" else 4 * least) and top >= sure * sum(rates.values()) and c[g] >= 0.5 * sum(c.values()):
            out[w] = [(g, 0.5)]
    return out


def defective_pairs(pairs: DataFrame, ends_share: float = 0.2, least_seen: int = 3) -> DataFrame:
    """Rows (pair_table, pair_id, defect), each pair once, for pairs (pair_table, pair_id, question, answer).

    A null answer is 'empty'. Where the question is null, copies and foreign languages are not judged. Repeated rows give
    one case; an empty table gives none; other columns are ignored. Answers of any length are read whole. A pair with
    several defects gets the first of: empty, copy, refusal, language, truncated.
    """
    answers = pairs.select("answer").where("answer <> ''")
    common = common_words(answers)
    lexicon = learned_lexicon(pairs, common)
    known = frozenset(common)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, i, q, a in zip(b["pair_table"], b["pair_id"], b["question"], b["answer"]):
                q, a = (q if isinstance(q, str) else None), (a if isinstance(a, str) else None)
                d = defect_of(q, a, lexicon)
                if d == "open":
                    words = masked(plain(a), known)
                    last = re.findall(r"[^\W\d_]+", a)[-1:]
                    cut_word = bool(last) and last[0].islower() and last[0] not in known and any(w.startswith(last[0]) for w in known)
                    rows.append((t, i, "truncated", None) if cut_word else (t, i, "open", _grams(words, len(words) - 1)))
                elif d:
                    rows.append((t, i, d, None))
            yield pd.DataFrame(rows, columns=["pair_table", "pair_id", "defect", "grams"])

    judged = pairs.select("pair_table", "pair_id", "question", "answer").mapInPandas(classify, "pair_table string, pair_id string, defect string, grams array<string>").distinct()
    judged = cut(judged)

    def count_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 2000):  # bounds the counts held at once
                seen, ends = ending_counts(b["answer"].iloc[k : k + 2000], known)
                yield pd.DataFrame([(g, ends[g], n) for g, n in seen.items()], columns=["gram", "ends", "seen"])

    ends = answers.mapInPandas(count_ends, "gram string, ends bigint, seen bigint").groupBy("gram").agg(F.sum("ends").alias("ends"), F.sum("seen").alias("seen"))
    asked = judged.where("defect = 'open'").select("pair_table", "pair_id", F.posexplode("grams").alias("k", "gram"))
    best = asked.join(ends, "gram", "left").groupBy("pair_table", "pair_id").agg(
        F.min_by(F.struct("ends", "seen"), F.when((F.col("k") > 0) & (F.col("seen") >= least_seen), F.col("k"))).alias("b"),
        F.max(F.when((F.col("k") == 0) & (F.col("seen") >= 3 * least_seen), F.col("ends") >= 0.5 * F.col("seen"))).alias("usual"),
    )
    cut_off = best.where(~F.coalesce("usual", F.lit(False)) & (F.col("b").isNull() | (F.col("b.ends") < ends_share * F.col("b.seen"))))
    return judged.where("defect <> 'open'").select("pair_table", "pair_id", "defect").unionByName(cut_off.select("pair_table", "pair_id", F.lit("truncated").alias("defect")))


def answer_pairs(questions: DataFrame, search_results: DataFrame) -> DataFrame:
    """Pairs of `questions`, and of `search_results` with the question they belong to (null where it is missing)."""
    q = questions.select("id", "question", "answer").where("id is not null")
    asked = q.groupBy(F.col("id").alias("question_id")).agg(F.min("question").alias("question"))
    own = q.select(F.lit("questions").alias("pair_table"), F.col("id").alias("pair_id"), "question", "answer")
    r = search_results.select("id", "question_id", "answer").where("id is not null").join(asked, "question_id", "left")
    return own.unionByName(r.select(F.lit("search_results").alias("pair_table"), F.col("id").alias("pair_id"), "question", "answer"))
