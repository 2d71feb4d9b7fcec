"""Fill-in-the-middle, SimHash and resampling against plain versions of their definitions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lapsekit.llm import fill_in_middle as fim
from lapsekit.llm import check_sql, queries, resampling, simhash
from lapsekit.llm.buffers import parts, text_bytes

SCHEMA = "doc_id bigint, text string, n bigint, key string, fp bigint, label string, score bigint, rank int, form string, fixed string, _place int, weight double, output string"
TEXTS = [
    None, "", " ", "\t\n ", "one", " one", "one ", "ÄÖ ü 日本 語  \x0b x", "has <P> in it", "<S", "a<M>b", "<P<S <M M>",
    "a b c d", "A B c D", "a b c d", "x" * 5000, "wörd " * 3000, "  ".join(f"w{i}" for i in range(2000)) + "\n\n", "é" * 1023 + " é" * 600,
    "\x00 nul \x00", "ab\x1cd \x85e", "same words here now again", "Same WORDS here now again",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) + (None,) * 11 for i, t in enumerate(TEXTS)]
    rows += [rows[7], rows[7], (None, "no key at all") + (None,) * 11, (None, None) + (None,) * 11, (1 << 60, "big key\n" * 50) + (None,) * 11]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fim(key, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = sha(f"42:{'' if key is None else key}")
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, len(p), len(m), sha(out), sha(text)


@pytest.mark.parametrize("table", ["docs", "real"])
def test_fill_in_middle(request, table):
    df = request.getfixturevalue(table)
    expected = Counter((r["doc_id"], *plain_fim(r["doc_id"], r["text"])) for r in df.collect())
    got = fim.fill_in_middle_digest(df)
    assert Counter(map(tuple, got.collect())) == expected
    assert len({form for _, _, form, *_ in expected}) == 3


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_every_cut_of_a_text(text):
    raw = text.encode()
    (index,) = fim.unit_indexes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert (index.units, index.points) == (len(units), len(text))
    points = 0
    for k, unit in enumerate([""] + units):
        points += len(unit)
        if k % 37 == 0 or k > len(units) - 3:
            assert index.cut(k) == (len(text[:points].encode()), points)


def test_very_long_text(spark):
    text = "длинный text  with words\n" * 150_000  # 5 MB
    row = fim.fill_in_middle_digest(spark.createDataFrame([(k, text) for k in range(4)], "doc_id bigint, text string")).collect()
    assert {tuple(r) for r in row} == {(k, *plain_fim(k, text)) for k in range(4)}


def test_parts_of_a_batch():
    texts = ["a" * 10, None, "b" * 50, "", "c" * 10, "d" * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["k", "t"])
    got = [p.column(0).to_pylist() for p in parts(batch.slice(1), 1, 20)]
    assert sum(got, []) == [1, 2, 3, 4, 5]
    for p in parts(batch.slice(1), 1, 20):
        data, bounds = text_bytes(p.column(1))
        assert [data[a:b].tobytes().decode() for a, b in zip(bounds, bounds[1:])] == [t or "" for t in p.column(1).to_pylist()]


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    width = min(4, len(words))
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """fps: {fingerprint: least key} to the least key of each fingerprint's component."""
    values = np.array(sorted(fps), np.uint64)
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values ^ v) <= 4):
            parent[root(int(j))] = root(i)
    least = defaultdict(list)
    for i, v in enumerate(values):
        if fps[int(v)] is not None:
            least[root(i)].append(fps[int(v)])
    return {int(v): min(least[root(i)], default=None) for i, v in enumerate(values)}


@pytest.mark.parametrize("table", ["docs", "real"])
def test_simhash(request, table):
    df = request.getfixturevalue(table)
    own = [(r["doc_id"], plain_fingerprint(r["text"])) for r in df.collect()]
    least = {}
    for key, fp in own:
        least[fp] = min((k for k in (least.get(fp), key) if k is not None), default=None)
    component = plain_components(least)
    expected = Counter((key, f"{fp:016x}", component[fp]) for key, fp in own)
    assert Counter(map(tuple, simhash.simhash_digest(df).collect())) == expected


@pytest.mark.parametrize("limit", [simhash.LIMIT, 40])
def test_links_connect_clusters_chains_and_crowds(spark, limit):
    """Dense balls, chains and fingerprints that share most of their bits, with keys cut further or not."""
    rng = np.random.default_rng(7)
    flips = lambda n: int(sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    values = set(int(x) for x in rng.integers(0, 1 << 63, 300)) | {0, (1 << 64) - 1}
    for _ in range(3):
        centre = int(rng.integers(0, 1 << 63))
        values |= {centre ^ flips(int(rng.integers(0, 4))) for _ in range(120)}
    chain = int(rng.integers(0, 1 << 63))
    for _ in range(150):
        chain ^= flips(4)
        values.add(chain)
    values |= {0x123456789ABCDEF0 ^ int(x) for x in rng.integers(0, 1 << 26, 400)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    fps = spark.createDataFrame(signed, "fp bigint").repartition(3)
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.fingerprint_links(fps, limit).collect()]
    assert all(1 <= (a ^ b).bit_count() <= 4 for a, b in links)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = defaultdict(set)
    for v in values:
        found[root(v)].add(v)
    expected = defaultdict(set)
    for v, c in plain_components({v: v for v in values}).items():
        expected[c].add(v)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_variants_hold_for_every_four_bits():
    rng = np.random.default_rng(3)
    for fixed in (0, 0xFFFFF, 0xF0F0F0F0F0):
        cuts = simhash.variants(fixed)
        free = [b for b in range(64) if not fixed >> b & 1]
        assert sorted(b for b, _ in cuts) == free
        for _ in range(200):
            differ = sum(1 << int(b) for b in rng.choice(free, 4, replace=False))
            assert any(not differ & more for _, more in cuts)


def test_spanning_links_are_few():
    members = np.arange(3000, dtype=np.uint64)
    a, b = simhash.spanning_links(members)
    assert len(a) == 2999 and (np.bitwise_count(a ^ b) <= 4).all()


def tokens(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_resample(rows, target, longest=1, buckets=10_000, min_words=20, share=10):
    def features(text):
        w = tokens(text)
        return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text)))
    for text in target:
        t.update(map(bucket, features(text)))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    out = []
    for key, text in rows:
        f = features(text)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(sha(f"2024:{'' if key is None else key}")[:8], 16)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((i for i, (_, text) in enumerate(rows) if len(tokens(text)) >= min_words), key=lambda i: (-out[i][3], out[i][0] is None, out[i][0]))
    for rank, i in enumerate(order[: share * len(order) // 100]):
        out[i][4] = rank + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize("table,options", [("docs", {"min_words": 1, "share": 60}), ("real", {}), ("real", {"longest": 3, "share": 40, "buckets": 997})])
def test_resampling(request, benchmark, table, options):
    df = request.getfixturevalue(table)
    got = Counter(map(tuple, resampling.resample(df, benchmark, **options).collect()))
    assert got == plain_resample([(r["doc_id"], r["text"]) for r in df.collect()], [r["text"] for r in benchmark.collect()], **options)


def test_ranks_with_ties_over_ranges(spark):
    rows = spark.range(5000).select(F.col("id").alias("key"), (F.col("id") % 7).alias("score")).repartition(5)
    ranked = resampling.with_ranks(rows, [F.desc("score"), F.asc("key")], 4000).orderBy(F.desc("score"), "key").collect()
    assert [r["rank"] for r in ranked] == [*range(1, 4001), *[None] * 1000]


@pytest.mark.parametrize("operator", ["op11_fill_in_middle", "op12_simhash", "op13_resampling"])
def test_empty_tables(docs, benchmark, operator):
    run = {
        "op11_fill_in_middle": fim.fill_in_middle_digest, "op12_simhash": simhash.simhash_digest,
        "op13_resampling": lambda df: resampling.resample(df, benchmark.limit(0)),
    }[operator]
    assert run(docs.limit(0)).collect() == []
    assert run(docs).count() == docs.count()


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_resampling"])
def test_equal_to_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    ours = queries.REGISTRY[name](spark, folder)
    theirs = con.sql(check_sql.statements()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    rows = theirs.fetchall()
    assert Counter(tuple(r[c] for c in theirs.columns) for r in ours.collect()) == Counter(rows) and rows
