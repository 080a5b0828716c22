from fractions import Fraction

import duckdb
import pytest

from lattica.llm import mixing


def documents(make, sizes, extra=False):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, f"t{i}", "en", source, 2))
            i += 1
    return make(rows, extra=extra)


def edf(quota):
    """Earliest deadline first over one period, block by block."""
    period, given, out = sum(quota.values()), dict.fromkeys(quota, 0), []
    for t in range(period):
        due = [(-(-(given[s] + 1) * period // q), k, s) for k, (s, q) in enumerate(sorted(quota.items())) if given[s] < q and given[s] * period // q <= t]
        out.append(min(due)[2])
        given[out[-1]] += 1
    return out


@pytest.mark.parametrize("targets", [None, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 7, "b": 1, "c": 1}, {"a": 0.333, "b": 0.25, "c": 1.5}])
def test_less_than_one_block_off(make, targets):
    """Slot by slot as by the definition, and against the exact targets over many periods."""
    docs = documents(make, {"a": 900, "b": 500, "c": 300})
    quota = {r.name: r.quota for r in mixing.quotas(docs, targets).collect()}
    period = sum(quota.values())
    if targets:
        exact = {k: Fraction(str(v)) for k, v in targets.items()}
        assert all(Fraction(quota["s" + k], period) == v / sum(exact.values()) for k, v in exact.items())
    else:
        sizes = {"sa": 900**0.7, "sb": 500**0.7, "sc": 300**0.7}
        assert all(abs(quota[k] / period - v / sum(sizes.values())) < 1 / mixing.PERIOD for k, v in sizes.items())
    slots = [r.name for r in sorted(mixing.pattern(mixing.quotas(docs, targets)).collect(), key=lambda r: r.slot)]
    assert slots == edf(quota)
    seen = dict.fromkeys(quota, 0)
    for t in range(1, 5 * period + 1):
        seen[slots[(t - 1) % period]] += 1
        assert all(abs(Fraction(q * t, period) - seen[s]) < 1 for s, q in quota.items())


def test_rounded_only_beyond_the_longest_period(make):
    docs = documents(make, {"a": 5, "b": 5})
    assert mixing._whole({"a": 1000, "b": 1}) == {"a": 1000, "b": 1} and mixing._whole({"a": 0.5, "b": 0.25}) == {"a": 2, "b": 1}
    quota = {r.name: r.quota for r in mixing.quotas(docs, {"a": 0.123456789, "b": 0.987654321}).collect()}
    assert abs(sum(quota.values()) - mixing.LONGEST) <= 1 and abs(quota["sa"] / quota["sb"] - 0.123456789 / 0.987654321) < 1e-4
    with pytest.raises(ValueError):
        mixing._whole({"a": 0.0})


def test_places(make):
    docs = documents(make, {"a": 700, "b": 100, None: 37}, extra=True)
    rows = mixing.scheduled(docs).collect()
    assert len(rows) == 837 and len({r.mix_position for r in rows}) == 837
    for source in ("a", "b", None):
        own = sorted((r for r in rows if r.source == source), key=lambda r: r.mix_position)
        blocks = {}
        for r in own:
            blocks.setdefault(r.mix_slot, []).append(r)
        assert all(len(x) == mixing.BLOCK for x in list(blocks.values())[:-1])
    ordered = mixing.mixed(docs.drop("mix_slot"))
    assert ordered.columns == docs.drop("mix_slot").columns
    place = {r.doc_id: r.mix_position for r in rows}
    got = [place[r.doc_id] for r in ordered.collect()]
    assert got == sorted(got)
    assert "Python" not in mixing.op8(docs)._jdf.queryExecution().executedPlan().toString()


def test_odd_rows(make, odd):
    rows = mixing.scheduled(make(odd, extra=True), {"web": 2.0, "gone": 1.0}).collect()
    assert len(rows) == len(odd) and len({r.mix_position for r in rows}) == len(odd)
    assert mixing.op8(make([])).count() == 0


def test_many_sources(make):
    """Weights count however many sources there are."""
    docs = documents(make, {f"s{i}": 3 for i in range(1200)} | {"big": 900})
    rows = mixing.op8(docs).collect()
    assert len(rows) == 4500 and len({r.mix_position for r in rows}) == 4500
    weight = {r.source: r.mix_weight for r in rows}
    assert 30 < weight["big"] / weight["s7"] < 80  # 300 ** 0.7 is 54


def test_as_the_sql(spark, sf):
    got = sorted(tuple(r[c] for c in ("doc_id", "source", "mix_slot", "mix_position", "mix_weight")) for r in mixing.op8(spark.read.parquet(f"{sf}/documents.parquet")).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got == sorted(con.execute(mixing.ORACLE).fetchall())
