import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewords.plans import found, outputs, records, timed

CORE = {k: f for m in (found, timed, records, outputs) for k, f in m.QUERIES.items()}
SQL = {k: q for m in (found, timed, records, outputs) for k, q in m.SQL.items()}


def _plain(v):
    return None if isinstance(v, float) and v != v else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(CORE))
def test_query(spark, data, name):
    df = CORE[name](spark, data)
    rows = df.collect()
    assert len(rows) >= 0
    if name in SQL:
        con = duckdb.connect()
        for p in glob.glob(f"{data}/*.parquet"):
            con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
        got = con.execute(SQL[name])
        cols = [c[0] for c in got.description]
        assert sorted(cols) == sorted(df.columns)
        key = lambda r: tuple(str(x) for x in r)
        want = sorted((tuple(_plain(r[cols.index(c)]) for c in df.columns) for r in got.fetchall()), key=key)
        assert sorted((tuple(map(_plain, r)) for r in rows), key=key) == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["tbl", "source_id", "gap_start_ms", "gap_end_ms"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_sql_by_value(spark, data):
    """What SQL can't say, against the standard library on all rows."""
    import difflib
    import statistics
    import unicodedata
    import zlib

    import xxhash

    clips = {r.id: r.text for r in spark.read.parquet(f"{data}/clips.parquet").where("id is not null").collect()}

    def heard(t):
        folded = unicodedata.normalize("NFKC", t).casefold()
        return " ".join("".join(c for c in folded if unicodedata.category(c)[0] not in "PS").split())

    assert {r.id: r.heard for r in CORE["normalized_text"](spark, data).collect()} == {i: t if t is None else heard(t) for i, t in clips.items()}
    for r in CORE["compression"](spark, data).collect():
        raw = (clips[r.id] or "").encode()
        assert r.ratio == (len(raw) / len(zlib.compress(raw)) if raw else 0.0)
    drops = {r.clip: r for r in CORE["filter_drops"](spark, data).collect()}
    native = {r.clip: r for r in CORE["drop_records"](spark, data).collect()}
    cands = {r.ref: (r.text or "").strip() for r in spark.read.parquet(f"{data}/clip_candidates.parquet").collect()}
    late = {i for i, r in drops.items() if r.filter == "compression_ratio"}
    ratio = lambda t: len(t.encode()) / len(zlib.compress(t.encode())) if t else 0.0
    early = {i for i, r in native.items() if r.filter != "confidence"}
    assert late == {i for i, t in cands.items() if i not in early and ratio(t) > 2.4}
    assert all(drops[i].value == f"{ratio(cands[i]):.2f}" and drops[i].threshold == "<=2.4" for i in late)
    assert {i: r for i, r in drops.items() if i not in late} == {i: r for i, r in native.items() if i not in late}

    def order(i):  # a chain of hashes: the id's, with it as seed that of the sample's seed
        first = xxhash.xxh64_intdigest(i.encode(), 42)
        h = xxhash.xxh64_intdigest((0).to_bytes(4, "little"), first)
        return h - (1 << 64) if h >> 63 else h

    some = sorted((i for i, t in clips.items() if t is not None), key=lambda i: (order(i), i))[:8]
    got = {r.id: (r.text, r.control) for r in CORE["cyclic_control"](spark, data).collect()}
    assert got == {i: (clips[i], clips[some[(k + 1) % 8]]) for k, i in enumerate(some)}

    full = spark.read.parquet(f"{data}/clips.parquet").where("id is not null").collect()
    said = {}
    for r in spark.read.parquet(f"{data}/clip_candidates.parquet").where("start_s is not null").collect():
        key = (r.source_id, round(r.start_s * 1000))
        said[key] = max(said.get(key) or "", r.text or "")
    pairs = {r.id: (r.text, said[r.source_id, round(r.start_s * 1000)]) for r in full if r.start_s is not None and (r.source_id, round(r.start_s * 1000)) in said}
    ids = sorted(pairs, key=lambda i: (order(i), i))[:8]
    like = lambda a, b: round(difflib.SequenceMatcher(None, heard(a), heard(b), autojunk=False).ratio(), 3)
    own = [like(pairs[i][1], pairs[i][0]) for i in ids]
    other = [like(pairs[i][1], pairs[ids[(k + 1) % len(ids)]][0]) for k, i in enumerate(ids)]
    got = CORE["pairing"](spark, data).first()
    assert abs(got.pairing_mean - statistics.mean(own)) < 6e-4 and abs(got.control_mean - statistics.mean(other)) < 6e-4 and abs(got.pairing_median - statistics.median(own)) < 6e-4
    assert abs(got.pairing_gap - (got.pairing_mean - got.control_mean)) < 1e-9
