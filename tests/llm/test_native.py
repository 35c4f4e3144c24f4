"""Ring shards and personal data: against brute force, on odd tables, and without Python on the executors."""

import zlib

from memloom.llm import pii, ring
from tests.llm import brute


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shards_hold_equal_counts_and_gapless_slots(spark, odd, odd_rows, none):
    got = ring.shard_documents(odd, shards=4, nodes=8).collect()
    assert len(got) == len(odd_rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    assert ring.shard_documents(none).collect() == []


def test_few_rows_leave_shards_empty(spark):
    got = ring.shard_documents(spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string"), shards=40).collect()
    assert sorted(r["slot"] for r in got) == [0, 0, 0] and len({r["shard"] for r in got}) == 3


def test_walk_overflows_clockwise():
    points = [(10, 0), (20, 1), (30, 2)]
    spans = ring.walk({0: 5, 1: 1, 2: 0}, points, 3)
    # Two of each shard: shard 0 keeps two of five, the next ones take what is left clockwise.
    assert spans == [(0, 0, 2, 0, 0), (1, 0, 1, 1, 0), (0, 2, 3, 1, 1), (0, 3, 5, 2, 0)]


def test_most_rows_stay_when_a_shard_is_added(spark):
    docs = spark.range(8000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    a = {r["doc_id"]: r["shard"] for r in ring.shard_documents(docs, 10).collect()}
    b = {r["doc_id"]: r["shard"] for r in ring.shard_documents(docs, 11).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.35 * len(a)  # a fresh deal would move ten in eleven


def test_pii_equals_brute_force(spark, odd, odd_rows, none, sf_dir):
    from memloom.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op4_pii"](spark, sf_dir).collect()}
    for i, text in rows:
        counts, _, sha = brute.pii(text)
        assert list(got[i][1:5]) == counts and got[i]["base_sha256"] == sha
    mine = sorted((str(r["doc_id"]), *r[1:6]) for r in pii.digest(pii.find_pii(odd)).collect())
    assert mine == sorted((str(i), *brute.pii(t)[0], brute.pii(t)[2]) for i, t, *_ in odd_rows)
    assert pii.digest(pii.find_pii(none)).collect() == []


def test_pii_hard_cases(spark):
    texts = ["a@b.c_d@e.f", "x@y x@y.z.", "1.2.3.4.5.6.7.8", "256.1.1.1.1", "00000001.2.3.255", "1.2.3.4@x.yz", "4111111111111111 4111111111111111",
             "12-3 4", "+1+1 (234) 567-890+2", "+49 30 1234567.", "0" * 3000 + "@", "..@..", "é@é.com 5500-0000-0000-0004", "a.b@c-d.e-f.g" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digest(pii.find_pii(df)).collect():
        counts, listed, sha = brute.pii(texts[r["doc_id"]])
        assert (list(r[1:5]), r["base_sha256"]) == (counts, sha), texts[r["doc_id"]][:60]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("iban")] == [s for s in listed.split(",") if s]


def test_checksums_context_and_redaction(spark):
    df = spark.createDataFrame([(1, "bank transfer GB82 WEST 1234 5698 7654 32 now"), (2, "GB83 WEST 1234 5698 7654 32"),
                                (3, "pay by card 4111111111111111"), (4, "order 4111111111111111")], "doc_id long, text string")
    found = pii.find_pii(df)
    got = {r["doc_id"]: r["pii"] for r in found.collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[1]] == [("iban", 14, 41)] and got[1][0]["score"] == 1.0 and got[2] == []
    assert got[3][0]["score"] > got[4][0]["score"]
    red = {r["doc_id"]: r["redacted"] for r in pii.redact(found).collect()}
    assert red[1] == "bank transfer [iban] now" and red[3] == "pay by card [card]" and red[2].startswith("GB83")


def test_no_python_on_executors(spark, sf_dir):
    from memloom.llm.queries import QUERIES

    for name in ("op3_ring_shards", "op4_pii"):
        plan = plan_of(QUERIES[name](spark, sf_dir))
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_iban_ends_where_its_country_says(spark):
    iban = "GB82 WEST 1234 5698 7654 32"
    texts = [f"{iban} BIC WESTGB2L", f"{iban} 100 EUR", f"{iban} now", f"AB12 {iban} BIC", "NO93 8601 1117 947 KTO 7", "DE89370400440532013000 USD", f"{iban}1 BIC", "GB83 WEST 1234 5698 7654 32 BIC"]
    want = [iban, iban, iban, iban, "NO93 8601 1117 947", "DE89370400440532013000", None, None]
    got = {r["doc_id"]: [r["text"][s["start"]:s["end"]] for s in r["pii"] if s["kind"] == "iban"]
           for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: [w] if w else [] for i, w in enumerate(want)}


def test_many_hits_in_a_long_text(spark):
    """A contact list: places and scores as in short texts, in time that grows with the list."""
    import time

    line = "mail bob@x.example.org or 10.0.0.255 call +49 (30) 1234-567 pay 4111-1111-1111-1111 é🎉\n"
    n = 4000
    df = spark.createDataFrame([(1, line * n), (2, line * 3), (3, "a@b.co " * 40_000)], "doc_id long, text string")
    pii.find_pii(df.where("doc_id = 2")).collect()
    start = time.time()
    got = {r["doc_id"]: r["pii"] for r in pii.find_pii(df).collect()}
    assert time.time() - start < 120
    assert len(got[3]) == 40_000 and (got[3][-1]["start"], got[3][-1]["end"]) == (39_999 * 7, 39_999 * 7 + 6)
    one = [s for s in got[2] if len(line) <= s["start"] < 2 * len(line)]
    for kind in pii.BASE_KINDS:
        mine = [s for s in got[1] if s["kind"] == kind]
        told = [s for s in one if s["kind"] == kind]
        assert len(mine) == n * len(told)
        assert [(s["start"], s["end"], s["score"]) for s in mine[len(told):-len(told)]] == [
            (s["start"] + (k - 1) * len(line), s["end"] + (k - 1) * len(line), s["score"]) for k in range(1, n - 1) for s in told]
