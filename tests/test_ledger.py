"""The ledger against a plain reading of the stream: pieces, re-sent and broken bundles, deaths between tables."""

import datetime
import random

import pytest

from palimpsest.scratch import scratch
from palimpsest.streaming import jobs, ledger

SCHEMA = "commit_id string, ts timestamp, fact long, n_facts long, kind string, entity long, lo int, hi int, retracts_fact_id long, at long"


def sent(seed, n=40):
    """Rows in the order of ``at``: bundles of one to five facts in pieces, some inverted, some again much later, one that stays short."""
    pick, out = random.Random(seed), []
    for b in range(n):
        size = pick.randrange(1, 6)
        bad = pick.random() < 0.2
        for f in range(size):
            row = (f"c{b:03}", datetime.datetime(2020, 1, 1) + datetime.timedelta(days=b), f, size, "existence", b % 7, 10, 5 if bad and f == 0 else 20, None)
            if not (b == n - 1 and f == 0 and size > 1):
                out.append((*row, b * 10 + pick.choice([0, 0, 60])))
            if b % 5 == 0:
                out.append((*row, 10 * n + 1000 + b))
    return out


def plain(rows):
    """{commit: (outcome, n_facts)} of the bundles that come whole."""
    facts = {}
    for r in rows:
        facts.setdefault(r[0], {})[r[2]] = r
    whole = {c: f for c, f in facts.items() if len(f) >= next(iter(f.values()))[3]}
    return {c: ("rejected", 0) if any(r[7] < r[6] for r in f.values()) else ("accepted", len(f)) for c, f in whole.items()}


def tables(spark, folder, schema):
    facts = sorted((r.commit_id, r.fact, r.fact_id) for r in ledger.facts(spark, folder, schema).collect())
    results = ledger.results(spark, folder).collect()
    return facts, results


def check(rows, facts, results):
    assert sorted(i for _, _, i in facts) == list(range(len(facts)))
    want = plain(rows)
    assert {c for c, _, _ in facts} == {c for c, (o, _) in want.items() if o == "accepted"}
    firsts = {r.commit_id: r for r in results if r.outcome == "accepted"}
    assert len(firsts) == sum(r.outcome == "accepted" for r in results)
    assert {c: ("accepted", r.n_facts) for c, r in firsts.items()} == {c: w for c, w in want.items() if w[0] == "accepted"}
    assert {r.commit_id for r in results if r.outcome == "rejected"} == {c for c, w in want.items() if w[0] == "rejected"}
    assert all(r.rules == ["inverted_window"] for r in results if r.outcome == "rejected")
    for r in results:
        if r.outcome == "replayed":
            assert (r.first_id, r.n_facts) == (firsts[r.commit_id].first_id, firsts[r.commit_id].n_facts) and r.batch > firsts[r.commit_id].batch
    for c, r in firsts.items():
        assert [i for x, _, i in facts if x == c] == list(range(r.first_id, r.first_id + r.n_facts))


def test_bundles(spark, seed=1):
    rows = sent(seed)
    stream = jobs.log_stream(spark, spark.createDataFrame(rows, SCHEMA), 4, "at").drop("at")
    folder = scratch(spark, "ledger")
    ledger.append(stream, folder)
    facts, results = tables(spark, folder, stream.schema)
    check(rows, facts, results)
    assert any(r.outcome == "replayed" for r in results)
    mentions = ledger.read(spark, folder, "mentions", "fact_id long, kind string, subject long").collect()
    assert sorted(m.fact_id for m in mentions) == list(range(len(facts)))
    # What the ledger still waits for is the bundle that stays short.
    short = {r.commit_id for r in ledger.still_pending(spark, folder, stream.schema).collect()}
    assert short == {r[0] for r in rows} - set(plain(rows))


def test_death_before_publishing(spark, monkeypatch):
    """A batch that dies after its tables and before its manifest is invisible, and its second run gives what one run gives."""
    rows = sent(3)
    stream = jobs.log_stream(spark, spark.createDataFrame(rows, SCHEMA), 3, "at").drop("at")
    once, twice = scratch(spark, "once"), scratch(spark, "twice")
    ledger.append(stream, once)
    publish, died = ledger._publish, []

    def dies(session, folder, i, next_id):
        if i == 1 and not died:
            died.append(i)
            raise RuntimeError("lost")
        publish(session, folder, i, next_id)

    monkeypatch.setattr(ledger, "_publish", dies)
    with pytest.raises(Exception, match="lost"):
        ledger.append(stream, twice)
    assert ledger.published(spark, twice)[0] == 0
    assert {r.batch for r in ledger.results(spark, twice).collect()} <= {0}
    ledger.append(stream, twice)
    assert tables(spark, twice, stream.schema) == tables(spark, once, stream.schema)
    check(rows, *tables(spark, twice, stream.schema))


def test_rules_of_the_log(spark):
    """A retraction of an unknown fact is refused, and taken once the log has the fact; an empty stream leaves an empty log."""
    day = datetime.datetime(2020, 1, 1)
    rows = [("a", day, 0, 1, "retract", None, None, None, 0, 0), ("b", day, 0, 1, "existence", 1, None, None, None, 10), ("a", day, 0, 1, "retract", None, None, None, 0, 20)]
    frame, path = spark.createDataFrame(rows, SCHEMA), scratch(spark, "log")
    for at in (0, 10, 20):  # one file after the other, as the stream reads them by their age
        frame.where(f"at = {at}").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path).drop("at")
    folder = scratch(spark, "ledger")
    ledger.append(stream, folder)
    facts, results = tables(spark, folder, stream.schema)
    assert facts == [("a", 0, 1), ("b", 0, 0)]
    assert sorted((r.batch, r.commit_id, r.outcome) for r in results) == [(0, "a", "rejected"), (1, "b", "accepted"), (2, "a", "accepted")]
    empty = scratch(spark, "empty")
    ledger.append(jobs.log_stream(spark, spark.createDataFrame([], SCHEMA), 1, "at").drop("at"), empty)
    assert tables(spark, empty, stream.schema) == ([], [])
