"""Packing, periodic runs and the filter audit against brute-force versions and exact round trips."""

import collections
import hashlib
import itertools
import random
import re
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from costlens.llm import audit, packing, periodic, queries
from costlens.llm.common import documents

from llm_fixtures import EDGE_ROWS, edge, empty  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SF).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# -- packing -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return packing.encoding(public_tokenizers.path(queries.BPE_RANKS), public_tokenizers.PATTERN,
                            tuple(queries.BPE_SPECIAL.items()))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def packed(docs, **more):
    return packing.pack_documents(docs, public_tokenizers.path(queries.BPE_RANKS), public_tokenizers.PATTERN,
                                  queries.BPE_SPECIAL, **more)


def wanted_pieces(text, library, capacity=1024):
    ids = library.encode(text or "", add_special_tokens=False).ids + [2]
    first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
    starts = [0, *range(first, len(ids), capacity)]
    return [(i, a, b - a, crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]


def assert_packed(rows, want, capacity=1024):
    """Every wanted piece once, sequences gapless and not over capacity; returns the number of sequences."""
    got = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == want
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_ids_are_those_of_the_tokenizers_library(coder, library):
    odd = ["", "a" * 3000, " " * 2000 + "x", "é" * 500, "日本語" * 90, "don't we'll I'm 'LL", "\n\n  \t x ", "\x1c\x1d a", " lead", "trail ",
           "<|endoftext|>", "a<|endoftext|> b <|endoftext|", "\U0001f600 é"]
    rng = random.Random(4)
    odd += ["".join(rng.choice("ab'stre 1.\n\té! ²٠") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for t in odd:
        assert packing.token_ids(t, coder).tolist() == library.encode(t, add_special_tokens=False).ids + [2], t


def test_pieces_of_all_documents(spark, docs, texts, library):
    want = collections.Counter((i, *p) for i, t in texts.items() for p in wanted_pieces(t, library))
    total = sum(k[3] for k in want)
    used = assert_packed(packed(docs).collect(), want)
    assert used <= -(-total // 1024) + 1


def test_levels_pack_what_tasks_leave(spark, docs, texts, library):
    """Many small blocks and few open bins a block: several levels, still whole and nearly as dense."""
    want = collections.Counter((i, *p) for i, t in texts.items() for p in wanted_pieces(t, library, 4096))
    many = docs.repartition(13)
    used = assert_packed(packed(many, capacity=4096, fan_in=3, window=10, open_bins=4).collect(), want, 4096)
    alone = assert_packed(packed(docs.coalesce(1), capacity=4096).collect(), want, 4096)
    assert used <= 1.1 * alone


def test_sequences_hold_the_ids(spark, docs, texts, library):
    rows = packing.sequences(packed(docs, with_ids=True)).collect()
    got = collections.Counter(i for r in rows for i in r["ids"])
    assert got == collections.Counter(i for t in texts.values() for i in library.encode(t or "", add_special_tokens=False).ids + [2])
    assert max(len(r["ids"]) for r in rows) <= 1024


def test_packing_of_edge_rows(edge, empty, library):
    want = collections.Counter((r[0], *p) for r in EDGE_ROWS for p in wanted_pieces(r[1], library))
    assert_packed(packed(edge).collect(), want)
    assert packed(empty).collect() == []
    text_ids = edge.selectExpr("'k' || doc_id AS doc_id", "text")
    assert packed(text_ids).count() == sum(want.values())


def test_a_table_of_one_repeated_row(spark, library):
    copies = spark.range(4000, numPartitions=6).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'the same few words' AS text")
    want = collections.Counter({(None, *p): 4000 for p in wanted_pieces("the same few words", library)})
    size = next(iter(want))[3]
    assert assert_packed(packed(copies).collect(), want) == -(-4000 // (1024 // size))


def test_best_fit_takes_the_fullest_bin_with_room():
    bins = packing.best_fit(np.array([5, 6, 4, 4, 1]), 10)
    assert sorted(map(sorted, bins)) == [[0, 3, 4], [1, 2]]


@pytest.mark.parametrize("contents,left", [
    ([[6], [4]], 1),  # a move
    ([[5, 3], [4, 2], [6]], 2),  # exchanges, then a bin is empty
    ([[7, 2], [4, 4], [3]], 2),  # one for one: 4 against 3
    ([[5, 4], [3, 3], [5]], 2),  # one for two
])
def test_exchanges_empty_bins(contents, left):
    items = sorted(itertools.chain.from_iterable(contents))
    search = packing.LocalSearch([list(c) for c in contents], 10)
    squares = (search.fill ** 2).sum()
    search.run()
    assert sorted(itertools.chain.from_iterable(search.contents)) == items
    assert all(sum(c) == f <= 10 for c, f in zip(search.contents, search.fill))
    assert (search.fill ** 2).sum() > squares and sum(bool(c) for c in search.contents) == left


def test_no_exchange_is_left_that_raises_the_squares():
    rng = random.Random(5)
    for _ in range(60):
        contents = [[rng.randint(1, 12) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(2, 7))]
        contents = [c for c in contents if sum(c) <= 24]
        search = packing.LocalSearch([list(c) for c in contents], 24)
        search.run(passes=50)
        fills = [sum(c) for c in search.contents]
        for a, b in itertools.permutations(range(len(fills)), 2):
            if not 0 < fills[a] < 24 or not 0 < fills[b] < 24:
                continue
            for give, back in ((1, 0), (1, 1), (2, 0), (2, 1), (1, 2)):
                for x in itertools.combinations(search.contents[a], give):
                    for y in itertools.combinations(search.contents[b], back):
                        d = sum(x) - sum(y)
                        assert not (0 < d <= 24 - fills[b] and (fills[b] + d) ** 2 + (fills[a] - d) ** 2 > fills[a] ** 2 + fills[b] ** 2)


def test_pack_keeps_every_piece():
    rng = np.random.default_rng(6)
    for sizes in (rng.integers(300, 700, 3000), rng.integers(1, 1025, 3000), np.full(2000, 1), np.full(500, 1024), np.zeros(0, int)):
        bins = packing.pack(sizes, 1024, neighbours=200)
        assert sorted(itertools.chain.from_iterable(bins)) == list(range(len(sizes)))
        assert all(sizes[b].sum() <= 1024 for b in bins)
        assert len(bins) <= len(packing.best_fit(sizes, 1024))


# -- periodic runs ---------------------------------------------------------------------------


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            stretch = w[i : i + length]
            if j > i and length >= max(6, 4 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


def test_runs_equal_brute_force():
    rng, seen = random.Random(3), 0
    for _ in range(1500):
        k, parts = rng.choice([1, 2, 2, 3]), []
        for _ in range(rng.randint(1, 5)):
            unit = [rng.randrange(k) for _ in range(rng.randint(1, 7))]
            parts += unit * rng.randint(1, 7) + [rng.randrange(k + 1) for _ in range(rng.randint(0, 3))]
        words = parts[:90]
        want = plain_runs(words)
        seen += len(want)
        assert [tuple(r) for r in periodic.find_runs(np.array(words, dtype=np.int64))] == want
        assert [[tuple(r) for r in x] for x in periodic.runs_of_texts([["x"], list(map(str, words)), []])] == [[], want, []]
    assert seen > 1000


def test_strongest_run_and_ties():
    runs = [periodic.Run(0, 8, 2), periodic.Run(9, 20, 5), periodic.Run(40, 9, 2)]
    assert periodic.strongest(runs) == runs[2]
    assert periodic.strongest(runs[:2]) == runs[0]
    assert periodic.strongest([]) is None


def test_long_uniform_and_periodic_texts_are_quick():
    n = 400_000
    assert periodic.find_runs(np.zeros(n, dtype=np.int64)) == [(0, n, 1)]
    assert periodic.find_runs(np.tile(np.arange(n // 4), 4)) == [(0, n, n // 4)]
    assert periodic.find_runs(np.tile(np.arange(n // 3), 3)) == []


def test_periodic_query_equals_brute_force(spark, texts):
    got = {tuple(r[c] for c in ("doc_id", *periodic.DIGESTS)) for r in queries.op12_periodic(spark, SF).collect()}
    want = {plain_row(i, t) for i, t in texts.items() if len(t or "") < 30_000}
    assert want <= got and len(got) == len(texts)
    assert sum(r[1] > 0 for r in want) > 5


def test_periodic_edge_rows(edge, empty):
    rows = periodic.periodic_runs(edge, periodic.DIGESTS, periodic.repeat_tail).collect()
    want = collections.Counter(plain_row(r[0], r[1]) for r in EDGE_ROWS if len(r[1] or "") < 30_000)
    assert not want - collections.Counter(tuple(r) for r in rows) and len(rows) == len(EDGE_ROWS)
    assert periodic.periodic_runs(empty).collect() == []


def test_runs_and_collapsed_text(spark):
    df = spark.createDataFrame([(1, "so a b a b a b a b end"), (2, "one two")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in periodic.periodic_runs(df).collect()}
    assert [tuple(x) for x in rows[1]["runs"]] == [(1, 8, 2)] and rows[1]["collapsed"] == "so a b end"
    assert rows[2]["runs"] == [] and rows[2]["collapsed"] == "one two"


# -- filter audit ------------------------------------------------------------------------------


def plain_audit(rows, labels):
    """One document, one order, one filter at a time."""
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    out = collections.defaultdict(lambda: dict.fromkeys(audit.MEASURES, 0))
    for order in itertools.permutations("ABCDE"):
        for doc_id, text, source in rows:
            t = text or ""
            words = re.findall(r"[^\x20\x09-\x0D]+", t)
            failed = {f for f, bad in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
                                       ("C", 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)), ("D", re.search(r"[#$%&*|]", t)),
                                       ("E", doc_id is not None and doc_id > first[t])) if bad}
            gone = False
            for step, f in enumerate(order, 1):
                row = out[source or "", "".join(order), step]
                if f in failed and not gone:
                    row["removed"] += 1
                    row["good_lost"] += doc_id in good
                    row["toxic_lost"] += doc_id in toxic
                    gone = True
                elif f in failed:
                    row["redundant"] += 1
                row["unique_fails"] += failed == {f}
                row["kept"] += not gone
    total = collections.Counter()
    for (part, order, step), row in out.items():
        total[part, order[step - 1]] += row["removed"]
    for (part, order, step), row in out.items():
        row["shapley"] = total[part, order[step - 1]]
    return {(*key, *row.values()) for key, row in out.items()}


def rows_of(df):
    return {tuple(r[c] for c in ("part", "filter_order", "step", *audit.MEASURES)) for r in df.collect()}


def test_audit_equals_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    marks = [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()]
    got = queries.op13_audit(spark, SF)
    assert rows_of(got) == plain_audit(rows, marks)
    assert got.count() == 600 * len({s or "" for _, _, s in rows})


def test_audit_of_edge_rows(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = rows_of(audit.audit(edge, labels))
    assert got == plain_audit([(r[0], r[1], r[3]) for r in EDGE_ROWS], [tuple(r) for r in labels.collect()])
    assert audit.audit(empty, labels).collect() == []
    assert rows_of(audit.audit(edge, labels.limit(0)))


def test_audit_with_other_filters(spark, edge):
    from pyspark.sql import functions as F
    one = audit.audit(edge, spark.createDataFrame([], "doc_id long, quality int, toxic int"),
                      {"x": F.length("text") > 3, "y": F.col("doc_id") > 5}, duplicate=None).collect()
    assert {r["filter_order"] for r in one} == {"xy", "yx"} and all(r["step"] in (1, 2) for r in one)


def test_min_plus_product_is_the_first_failing_step():
    orders = audit.Orders("ABC")
    removal = orders.removal(np.arange(8))
    for mask in range(8):
        for o, name in enumerate(orders.names):
            steps = [s for s, f in enumerate(name) if mask >> "ABC".index(f) & 1]
            assert removal[mask, o] == min(steps, default=3)


def test_hot_texts_and_ids_are_counted_before_they_meet(spark):
    """A third of the rows share a text, another third id and text: rows are combined map-side."""
    df = spark.range(9000, numPartitions=4).selectExpr(
        "CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS doc_id", "CASE WHEN id % 3 < 2 THEN 'hot' ELSE 'cold ' || id END AS text",
        "'s' AS source")
    got = audit.failures(df, audit.row_filters())
    assert {(r["mask"] >> 4, r["n"]) for r in got.groupBy("mask").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {(1, 3000), (0, 6000)}
