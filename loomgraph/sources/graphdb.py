"""A graph database as a sink: merge statements sent in batches by the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame


def open_session(uri: str, user: str, password: str, database: str | None = None):
    """A session of the database's own driver, where that is installed."""
    try:
        from neo4j import GraphDatabase
    except ImportError as e:
        raise ModuleNotFoundError("writing to a graph database needs its driver package, which is not installed") from e
    return GraphDatabase.driver(uri, auth=(user, password)).session(database=database)


def batches(items: Iterable, size: int) -> Iterator[list]:
    held: list = []
    for x in items:
        held.append(x)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def write_statements(statements: DataFrame, connect: Callable[[], object], size: int = 500) -> None:
    """Run rows (kind, statement), all nodes before all edges. Statements are idempotent, so a task that runs again does no harm.

    `connect` gives an object with run(statement) and close(); each task opens its own and sends statements by `size`, with
    begin_transaction() and commit() around each batch where it has them.
    """

    def send(rows) -> None:
        session = connect()
        try:
            for part in batches(rows, size):
                t = session.begin_transaction() if hasattr(session, "begin_transaction") else session
                for r in part:
                    t.run(r["statement"])
                if t is not session:
                    t.commit()
        finally:
            session.close()

    for kind in ("node", "edge"):
        statements.where(statements["kind"] == kind).foreachPartition(send)
