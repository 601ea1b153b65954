"""Alignment, exact duplicates and centroid clustering against plain Python and SQL, and on odd inputs."""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from coverline.llm import alignment, exactdedup, heapmeans, tokens
from coverline.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string, lang string, digest string, block string, pairs string, n string, best string"
LONG = " ".join(f"word{i % 700}" for i in range(30000))
ODD = [
    (1, "the quick brown fox", "en", "x", "y", None, None, None), (2, "the quick\tbrown  fox ", None, None, None, None, None, None), (3, "thequickbrownfox", "en", "x", None, None, None, None), (3, "thequickbrownfox", "en", "x", None, None, None, None),
    (4, None, None, None, None, None, None, None), (5, "", "en", None, None, None, None, None), (6, " \t\n\x0b\x0c\r ", "de", None, None, None, None, None), (7, "a b", None, None, None, None, None, None), (8, "ab", None, None, None, None, None, None), (9, "a b", None, None, None, None, None, None),
    (None, "ohne Nummer", "de", None, None, None, None, None), (None, "ohneNummer", "de", None, None, None, None, None), (None, "allein", "de", None, None, None, None, None), (10, LONG, "en", None, None, None, None, None), (11, LONG.replace(" ", "\n"), "en", None, None, None, None, None),
    (12, "🦄 日本語 <|endoftext|> <s> naïve ﬁ x\x00y", "es", None, None, None, None, None), (13, "has ▁ in it", "en", None, None, None, None, None), (14, "  two  spaces  ", "en", None, None, None, None, None), (15, "x", "en", None, None, None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def in_duckdb(sql: str, folder: str, *tables: str) -> list[tuple]:
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return sorted(tuple(r[i] for i in order) for r in found.fetchall())


# 12: exact duplicates


def brute_exact(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), key is None, key or 0))
    out = []
    for key, text in rows:
        plain = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[plain])
        keep = None if best[1] else best[2]
        out.append((key, keep, len(groups[plain]), key == keep and len(text or "") == -best[0], hashlib.sha256(plain.encode()).hexdigest()))
    return out


def plainly(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_exact_duplicates_of_odd_rows(odd, none):
    assert plainly(exactdedup.exact_duplicates(odd)) == sorted(brute_exact([(r[0], r[1]) for r in ODD]), key=repr)
    assert exactdedup.exact_duplicates(none).collect() == []


def test_exact_duplicates_as_in_sql(spark, small):
    got = QUERIES["op12_exact"](spark, small)
    assert sorted(tuple(r[c] for c in sorted(got.columns)) for r in got.collect()) == in_duckdb(SQL["op12_exact"], small, "documents")


def test_an_index_outlives_its_session_and_takes_new_texts_only(spark, odd, tmp_path):
    folder = str(tmp_path / "index")
    first = exactdedup.Index(spark, folder, buckets=3)
    before = plainly(exactdedup.deduplicate(odd, first))
    size = first.table().count()
    assert size == len({r[-1] for r in before})
    first.close()
    again = exactdedup.Index(spark, folder)
    assert again.buckets == 3
    assert plainly(exactdedup.deduplicate(odd, again)) == before and again.table().count() == size
    more = spark.createDataFrame([(90, "the quick brown fox and its much longer copy"), (91, "the  quick   brown    fox, no"), (92, "the   quick   brown   fox"), (93, "new"), (94, "n e w")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in exactdedup.deduplicate(more, again).collect()}
    assert got == {90: (90, True, 1), 91: (91, True, 1), 92: (2, False, 1), 93: (94, False, 2), 94: (94, True, 2)}
    assert again.table().count() == size + 3 and again.table().select("digest").distinct().count() == size + 3
    copy = again.rebuilt(str(tmp_path / "copy"), 2)
    assert sorted(map(tuple, copy.table().collect())) == sorted(map(tuple, again.table().collect()))
    again.close()
    copy.close()


def test_the_index_meets_a_batch_without_a_shuffle_of_its_own(spark, odd, tmp_path):
    index = exactdedup.Index(spark, str(tmp_path / "index"), buckets=4)
    exactdedup.deduplicate(odd, index)
    heads = spark.range(10).select(exactdedup.digest(F.col("id").cast("string")).alias("digest"), "id")
    plan = index.missing(heads)._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("FileScan") - 400 :]
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in side[side.index("Filter") :]
    index.close()


# 13: centroids


def brute_clusters(rows, clusters=8, rounds=10, width=64):
    kept = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) and abs(x) <= 131072 for x in v)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    centres = [list(v) for _, v in start]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        got = assign()
        for c in range(len(centres)):
            mine = [v for (_, v), (k, _) in zip(kept, got) if k == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    got = assign() if centres else []
    inertia = Counter()
    for c, d in got:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _), (c, d) in zip(kept, got)), key=repr)


def clusters_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


VECTORS = "vec_id long, embedding array<float>, cluster string, block string, part string"


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(i % 5, 0.3, 64)]) for i in range(160)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (200, None), (201, []), (202, [1.0] * 63), (203, [None] + [0.0] * 63), (204, [math.nan] + [0.0] * 63), (205, [math.inf] + [0.0] * 63), (206, [0.0] * 64), (207, [3e38] + [0.0] * 63)]
    rows += [(300 + i, rows[0][1]) for i in range(90)]  # one common vector
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], VECTORS)
    assert clusters_of(heapmeans.clustered(df)) == brute_clusters(rows)


def test_clusters_of_few_vectors(spark):
    for n in (0, 1, 5):
        rows = [(i, [float(i % 3)] * 64) for i in range(n)]
        assert clusters_of(heapmeans.clustered(spark.createDataFrame([(*r, None, None, None) for r in rows], VECTORS))) == brute_clusters(rows)


def test_clusters_as_in_sql(spark, small):
    got = QUERIES["op13_centroids"](spark, small)
    assert sorted(tuple(r[c] for c in sorted(got.columns)) for r in got.collect()) == in_duckdb(SQL["op13_centroids"], small, "embeddings")


def test_heaps_spare_most_measurements_and_change_nothing(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (8, 64))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 8] + rng.normal(0, 0.2, 64)]) for i in range(3000)]
    done = heapmeans.cluster(spark.createDataFrame([(*r, None, None, None) for r in rows], VECTORS))
    assert done.measured[0] == 3000 and sum(done.measured[3:]) < 3000
    assert sorted(map(tuple, done.rows.collect())) == sorted(r[:3] for r in brute_clusters(rows))


def test_a_round_pops_only_what_has_expired():
    heap = [(float(x), x) for x in (5, 1, 4, 2, 3)]
    heapq.heapify(heap)
    assert heapmeans.expired(heap, 2.5) == [1, 2] and sorted(heap) == [(3.0, 3), (4.0, 4), (5.0, 5)]


def test_rounds_of_a_block_agree_with_measuring_everything():
    rng = np.random.default_rng(9)
    vectors = rng.integers(-50, 50, (400, 6)).astype("<i4")
    centres, drift, heaps, sums = rng.integers(-50, 50, (5, 6)), np.zeros(5), None, np.zeros((5, 7), np.int64)
    for _ in range(30):
        heaps, gained, _ = heapmeans.advance(vectors, heaps, centres, drift)
        sums += gained
        cluster = np.empty(400, int)
        for c, heap in enumerate(heaps):
            cluster[[p for _, p in heap]] = c
        assert (cluster == heapmeans.distances(vectors.astype(np.int64), centres).argmin(axis=1)).all()
        assert all((sums[c, :6] == vectors[cluster == c].sum(axis=0)).all() and sums[c, 6] == (cluster == c).sum() for c in range(5))
        moved = centres + rng.integers(-3, 4, centres.shape)
        steps = np.sqrt(((moved - centres) ** 2).sum(axis=1))
        drift = drift + [steps[c] + np.delete(steps, c).max() for c in range(5)]
        centres = moved


# 11: alignment


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_tokenizer())
    own.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())
    byte_of = tokens.byte_table()
    docs = []
    for key, text in rows:
        a = b = []
        if text:
            a = own.encode(" " + text, add_special_tokens=False).ids
            b = sp.encode(text)
        a_bytes = [bytes(byte_of[c] for c in own.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            a, b, a_bytes, b_bytes = [], [], [], []
        links, i, j, at_a, at_b = [], 0, 0, 0, 0
        groups, left, right = [], [], []
        while i < len(a):
            links.append((a[i], b[j]))
            left, right = left or [a[i]], right or [b[j]]
            end_a, end_b = at_a + len(a_bytes[i]), at_b + len(b_bytes[j])
            if end_a <= end_b:
                at_a, i = end_a, i + 1
            if end_b <= end_a:
                at_b, j = end_b, j + 1
            if end_a == end_b:
                groups.append((left, right))
                left, right = [], []
            elif end_a < end_b:
                left.append(a[i])
            else:
                right.append(b[j])
        docs.append((key, len(a), len(b), links, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups), len(groups)))
    count, best = Counter(), Counter()
    for d in docs:
        count.update(set(d[3]))
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(
        ((key, n_a, n_b, n_groups, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "") for key, n_a, n_b, links, text, n_groups in docs), key=repr
    )


def alignments_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def test_alignment_of_odd_rows(odd, none):
    assert alignments_of(alignment.alignment(odd)) == brute_alignment([(r[0], r[1]) for r in ODD])
    assert alignment.alignment(none).collect() == []


def test_alignment_of_documents(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = brute_alignment([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert alignments_of(QUERIES["op11_alignment"](spark, small)) == want


def test_groups_hold_the_ids_of_both_sides(spark):
    rows = alignment.align(spark.createDataFrame([(1, "unbelievable naïve words"), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    left = [i for g in rows[0].groups.split(";") for i in g.split("|")[0].split(",")]
    assert len(left) == rows[0].n_a and rows[0].groups.count(";") + 1 == rows[0].n_groups and sum(rows[0].times) == rows[0].n_links
    assert rows[1].groups == "" and rows[1].pairs == []


def test_a_file_whose_ids_do_not_follow_its_merges_keeps_its_own_ids(tmp_path):
    from tokenizers import Tokenizer

    with open(tokens.default_tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    assert tokens.follows_merges(spec["model"], set())
    spec["model"]["vocab"] = {t: i for i, t in enumerate(sorted(vocab, key=lambda t: hashlib.md5(t.encode()).digest()))}
    assert not tokens.follows_merges(spec["model"], set())
    path = str(tmp_path / "permuted.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    text = "Permuted identifiers, with merges unchanged: naïve 日本語 " + "abc" * 9000
    assert tokens.encoder(path)(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    own = Tokenizer.from_file(tokens.default_tokenizer())
    assert tokens.encoder()(text) == own.encode(text, add_special_tokens=False).ids
    assert tokens.encoder()("a<|endoftext|>") != tokens.encoder(specials=False)("a<|endoftext|>")
