"""Each operator against a brute-force version on a table with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from .docs import SCHEMA, rows

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def text(t):
    return t or ""


def lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def majority(pairs):
    votes = [0] * 64
    total = sum(w for _, w in pairs)
    for h, w in pairs:
        for b in range(64):
            votes[b] += w * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


def xx(s):
    return xxhash.xxh64_intdigest(s.encode(), 42)


def own_fingerprint(t):
    ws = words(t)
    terms = [*dict.fromkeys(ws), *dict.fromkeys(f"{a} {b}" for a, b in zip(ws, ws[1:]))]
    return majority([(xx(x), min(len(x), 16)) for x in terms])


def test_fingerprints(docs, none):
    from rondelle.llm.fingerprints import fingerprint_documents

    got = fingerprint_documents(docs).collect()
    order = sorted(((d, text(t)) for d, t, *_ in rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = Counter()
    n = len(order)
    fps = [own_fingerprint(t) for _, t in order]
    distinct = set(fps)
    for i, (d, t) in enumerate(order):
        following, r = order[(i + 1) % n][1], len(t) // 4
        edited = t[: len(t) - r] + following[:r]
        e = own_fingerprint(edited)
        near = lambda x, y: 1 - (x ^ y).bit_count() / 64
        count = sum((fps[i] ^ f).bit_count() <= 3 for f in distinct) - 1 if d is not None and d % 20 == 0 else None
        want[(d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{fps[i]:016x}", f"{e:016x}", near(fps[i], e), near(fps[i], fps[(i + 1) % n]), count)] += 1
    assert Counter(tuple(r) for r in got) == want
    assert fingerprint_documents(none).collect() == []


@pytest.mark.parametrize("blocks", [None, 4, 5, 6])
def test_within_radius(spark, blocks):
    from rondelle.llm.simhash import within_radius

    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(20)]
    vals = {b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(5))) for b in base for _ in range(8)} | set(base)
    vals = {v & (2**64 - 1) for v in vals}
    signed = lambda v: v - 2**64 if v >> 63 else v
    index = spark.createDataFrame([(signed(v),) for v in vals], "fp bigint")
    asked = sorted(vals)[::7]
    q = spark.createDataFrame([(signed(v),) for v in asked], "query_fp bigint")
    want = Counter((signed(a), signed(b)) for a in asked for b in vals if (a ^ b).bit_count() <= 3)
    assert Counter(map(tuple, within_radius(q, index, 3, blocks).collect())) == want


def components(fps, radius=3):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_dedup(docs, none):
    from rondelle.llm.near_dedup import near_duplicates

    def fp(t):
        ws = words(t)
        sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) > 2 else [" ".join(ws)] if ws else []
        return majority([(xx(s), 1) for s in sh]) if sh else 0

    given = [(d, text(t)) for d, t, *_ in rows()]
    distinct = sorted({fp(t) for _, t in given})
    group = dict(zip(distinct, components(distinct)))
    smallest = defaultdict(lambda: None)
    for d, t in given:
        if d is not None:
            k = group[fp(t)]
            smallest[k] = d if smallest[k] is None else min(smallest[k], d)
    want = Counter((d, f"{fp(t):016x}", smallest[group[fp(t)]]) for d, t in given)
    assert Counter(map(tuple, near_duplicates(docs).collect())) == want
    assert near_duplicates(none).collect() == []


LONE = 0x3FFFF000F0F0F000


def test_near_dedup_links_through_rows_without_id(spark, monkeypatch):
    """1 - null - 9, each 3 bits from the next, are one component; small batches and hot fingerprints change nothing."""
    from rondelle.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BATCH_VALUES", 5)
    rnd = random.Random(8)
    far = [rnd.getrandbits(63) for _ in range(300)]
    given = [(9, 0b111000), (None, 0b111), (1, 0), (None, LONE), *((20 + i, f) for i, f in enumerate(far)), *((400 + i, f ^ 5) for i, f in enumerate(far[:90])), *((1000 + i, far[0]) for i in range(400))]
    rows = spark.createDataFrame(given, "doc_id bigint, fp bigint").cache()
    monkeypatch.setattr(near_dedup, "fingerprints", lambda docs, words: docs)
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in near_dedup.near_duplicates(rows).collect()}
    group = dict(zip(sorted({f for _, f in given}), components(sorted({f for _, f in given}))))
    least = {}
    for d, f in given:
        if d is not None:
            least[group[f]] = min(d, least.get(group[f], d))
    assert got == {(d, f"{f:016x}"): least.get(group[f]) for d, f in given}
    assert got[9, f"{0b111000:016x}"] == got[None, f"{0b111:016x}"] == 1 and got[None, f"{LONE:016x}"] is None


@pytest.mark.parametrize("seed", range(4))
def test_trie(seed):
    from rondelle.llm.trie import classes

    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(15)]
    vals = sorted({(b ^ sum(1 << rnd.randrange(48) for _ in range(rnd.randrange(6)))) & (2**64 - 1) for b in base for _ in range(60)})
    for key_bits, radius in ((16, 3), (16, 1), (25, 2)):
        got = classes(np.array(vals, np.uint64), key_bits, radius)
        parent = list(range(len(vals)))
        for i in range(len(vals)):
            for j in range(i):
                if vals[i] >> (64 - key_bits) == vals[j] >> (64 - key_bits) and (vals[i] ^ vals[j]).bit_count() <= radius:
                    a, b = parent[i], parent[j]
                    if a != b:
                        parent = [min(a, b) if p in (a, b) else p for p in parent]
        assert list(got) == parent


def test_connected(spark):
    from rondelle.llm.components import connected

    links = [(i, i + 1) for i in range(100)] + [(200, 201), (300, 200), (None, 5), (7, 7)] + [(400, 400 + i) for i in range(1, 50)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, 201: 200, 300: 200, **{400 + i: 400 for i in range(1, 50)}}


def test_sharding(spark, docs, none):
    from rondelle.llm.sharding import lookup_table, place, shard_names

    names = shard_names(7)
    full = lookup_table(names, 211)
    assert max(Counter(full).values()) - min(Counter(full).values()) <= 1
    less = lookup_table(names[:-1], 211)
    assert sum(a != b for a, b in zip(full, less)) < 211 / 3
    with pytest.raises(ValueError):
        lookup_table(names, 210)
    got = place(docs, "doc_id", names, 211).collect()
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 211
        assert (r["slot"], r["shard"]) == (slot, names[full[slot]])
    assert len(got) == len(rows()) and place(none, "doc_id", names, 211).collect() == []
    plan = place(docs, "doc_id", names, 211)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan


REC = "record_id bigint, url string, at bigint, kind string, etag string, modified string, headers map<string,string>, _piece int"


@pytest.mark.parametrize("pieces", [1, 3, 64])
def test_revisits(spark, pieces):
    from rondelle.llm.warc import PERMITTED, resolve_revisits

    rnd = random.Random(5)
    urls = ["http://a.com/x", "https://www.A.com/x/#f", "http://a.com/x?utm_source=q", "http://b.org/", "https://b.org:443/index.html", None]
    given = []
    for i in range(300):
        kind = rnd.choice(["response", "revisit", "revisit"])
        given.append((i, rnd.choice(urls), rnd.randrange(60) if i % 41 else None, kind, rnd.choice(["e1", "W/e1", "e2", None]), rnd.choice(["m1", "m2", None]), rnd.choice([{"Date": str(i), "X": "1", "ETag": "q"}, {"date": str(i)}, None]), 1))
    given.append(given[7])
    canon = lambda u: None if u is None else "a.com/x" if "/x" in u else "b.org"
    bare = lambda e: e[2:] if e.startswith("W/") else e
    want = Counter()
    for r in given:
        i, u, at, kind, etag, mod, heads, _ = r
        out, ref, heads = "full", None, dict(heads or {})
        if kind == "revisit":
            earlier = [x for x in given if x[3] == "response" and u is not None and at is not None and x[2] is not None and canon(x[1]) == canon(u) and (x[2], x[0]) < (at, i)]
            best = max(earlier, key=lambda x: (x[2], x[0])) if earlier else None
            if best is None:
                out = "missing"
            elif etag and best[4]:
                out = "resolved" if bare(etag) == bare(best[4]) else "mismatch"
            elif mod and best[5]:
                out = "resolved" if mod == best[5] else "mismatch"
            else:
                out = "unvalidated"
            if out in ("resolved", "unvalidated"):
                ref = best[0]
            if out == "resolved":
                new = {k: v for k, v in heads.items() if k.lower() in PERMITTED}
                heads = {k: v for k, v in (best[6] or {}).items() if k.lower() not in {x.lower() for x in new}} | new
        want[(i, canon(u), kind, at, ref, out, tuple(sorted(heads.items())))] += 1
    df = spark.createDataFrame(given, REC)
    got = Counter((*tuple(r)[:6], tuple(sorted(r["headers"].items()))) for r in resolve_revisits(df, pieces).collect())
    assert got == want
    assert resolve_revisits(df.where("false"), pieces).collect() == []


def squeeze(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text(t))


@pytest.mark.parametrize("files", [None, 1])
def test_exact_dedup(docs, none, files):
    from rondelle.llm.exact_dedup import exact_groups

    got = exact_groups(docs, files_per_batch=files)
    assert [c for c in docs.columns if c != "kept"] + ["keep_id", "group_size", "kept", "text_sha256"] == got.columns
    got = got.collect()
    groups = defaultdict(list)
    for d, t, *_ in rows():
        groups[squeeze(t)].append(d)
    assert len(got) == len(rows())
    for r in got:
        own = groups[squeeze(r["text"])]
        ids = [d for d in own if d is not None]
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (min(ids) if ids else None, len(own), hashlib.sha256(squeeze(r["text"]).encode()).hexdigest())
    assert sorted(squeeze(r["text"]) for r in got if r["kept"]) == sorted(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_groups(none).collect() == []


def test_exact_dedup_takes_clashes_apart(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from rondelle.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "digest", lambda: F.lit(bytearray(b"same")))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(4, "a"), (2, "b"), (1, "a"), (3, "b"), (5, "c")], "doc_id bigint, text string").write.parquet(path)
    got = exact_dedup.exact_groups(spark.read.parquet(path)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(1, 1, 2, True), (2, 2, 2, True), (3, 2, 2, False), (4, 1, 2, False), (5, 5, 1, True)]


def test_exact_dedup_reads_only_its_files(spark, tmp_path):
    """Other files of the folder count for nothing; a filtered or made table is taken as it is."""
    from rondelle.llm.exact_dedup import exact_groups, group_ids

    at = str(tmp_path / "a [1] {x},y")
    for i, given in enumerate([[(5, "a"), (7, "b")], [(6, "a")], [(1, "a"), (2, "b")]]):
        spark.createDataFrame(given, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/part{i}")
    import shutil
    from pathlib import Path

    Path(at).mkdir()
    for i in range(3):
        shutil.copy(next(Path(f"{tmp_path}/part{i}").glob("*.parquet")), f"{at}/{i}.parquet")
    escape = lambda p: "".join("\\" + c if c in "[]{},*?\\" else c for c in p)
    docs = spark.read.parquet(*[escape(f"{at}/{i}.parquet") for i in range(2)])
    want = [(5, 5, 2, True), (6, 5, 2, False), (7, 7, 1, True)]
    for got in (exact_groups(docs), group_ids(docs), exact_groups(docs.where("doc_id < 9")), group_ids(spark.createDataFrame(docs.collect(), docs.schema))):
        assert sorted(tuple(r)[:4] for r in got.select("doc_id", "keep_id", "group_size", "kept").collect()) == want


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    """A second call finds the texts of the first, checks their bytes at the locator, and keeps what was kept."""
    from rondelle.llm.exact_dedup import exact_groups, group_ids

    state, kind = str(tmp_path / "state"), "doc_id bigint, text string"
    batches = [[(5, "a  b"), (6, "a b"), (7, "c"), (None, "d")], [(1, "a\nb"), (2, "e"), (3, "e"), (4, "d")], [(8, "c"), (9, "e"), (10, None), (11, "")]]
    wants = [
        [(5, 5, 2, True), (6, 5, 2, False), (7, 7, 1, True), (None, None, 1, True)],
        [(1, 5, 3, False), (2, 2, 2, True), (3, 2, 2, False), (4, None, 2, False)],
        [(8, 7, 2, False), (9, 2, 3, False), (10, 10, 2, True), (11, 10, 2, False)],
    ]
    for i, (given, want) in enumerate(zip(batches, wants, strict=True)):
        spark.createDataFrame(given, kind).write.parquet(f"{tmp_path}/in {i}")
        got = (exact_groups if i % 2 else group_ids)(spark.read.parquet(f"{tmp_path}/in {i}"), state=state)
        assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept").collect()), key=str) == sorted(want, key=str)


def word_ids(t, end):
    return Tokenizer.from_file(WORD).encode(text(t), add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, none):
    from rondelle.llm.packing import pack_documents

    got = pack_documents(docs, WORD).collect()
    want = Counter()
    for d, t, *_ in rows():
        ids = word_ids(t, 0)
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(d, piece, at, len(part), crc(part))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert pack_documents(none, WORD).collect() == []


def test_patterns_fill_bins():
    from rondelle.llm.packing import fullest, patterns

    rnd = random.Random(2)
    for _ in range(30):
        cap = rnd.randrange(5, 40)
        h = Counter(rnd.randrange(1, cap + 1) for _ in range(rnd.randrange(1, 60)))
        made = patterns(h, cap)
        used = Counter()
        for bins, items in made:
            assert sum(items) <= cap
            for n in items:
                used[n] += bins
        assert used == h
        counts = [h.get(n, 0) for n in range(cap + 1)]
        sums = {0}
        for n, c in h.items():
            for _ in range(c):
                sums |= {s + n for s in sums if s + n <= cap}
        assert sum(fullest(counts, cap)) == max(sums)


def test_token_files(spark, docs, none, tmp_path):
    from rondelle.llm.token_files import read_tokens, token_round_trip, write_tokens

    order = sorted(((d, text(t)) for d, t, *_ in rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want, at = Counter(), 0
    for d, t in order:
        ids = word_ids(t, 2)
        want[(d, at, len(ids), crc(ids))] += 1
        at += len(ids)
    assert Counter(map(tuple, token_round_trip(docs, WORD).collect())) == want
    write_tokens(docs, WORD, str(tmp_path / "small"), image_ids=50)
    assert Counter(map(tuple, read_tokens(spark, str(tmp_path / "small")).collect())) == want
    assert token_round_trip(none, WORD).collect() == []


def test_pfor():
    from rondelle.llm.pfor import Reader, encode

    r = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 3000):
        for top in (1, 300, 49408, 2**32 - 1):
            ids = r.integers(0, top, n, dtype=np.uint64).astype("<u4")
            ids[r.random(n) < 0.05] = 2**32 - 1
            reader = Reader(encode(ids, [None, 5], np.array([n, 0])))
            assert (reader.ids() == ids).all() and reader.doc_ids == [None, 5] and list(reader.lengths) == [n, 0]
            for _ in range(5):
                a, b = sorted(r.integers(0, n + 1, 2))
                assert (reader.ids(a, b) == ids[a:b]).all()
    tight = encode(np.array([7] * 1270 + [40_000] * 10, "<u4"), [1], np.array([1280]))
    assert len(tight) < 400


@pytest.mark.parametrize("limit", [0, 5, 1 << 19])
def test_word_table(docs, none, limit):
    from rondelle.llm.word_tables import encode_decode

    tok = Tokenizer.from_file(BYTE)
    want = Counter()
    for d, t, *_ in rows():
        ids = tok.encode(text(t), add_special_tokens=False).ids
        want[(d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(map(tuple, encode_decode(docs, BYTE, limit).collect())) == want
    assert encode_decode(none, BYTE, limit).collect() == []


def test_token_counts(docs, none):
    from rondelle.llm.token_counts import count_tokens

    tok = Tokenizer.from_file(BYTE)
    want = Counter()
    for d, t, *_ in rows():
        n = len(tok.encode(text(t), add_special_tokens=False).ids)
        want[(d, len(text(t).encode()), n, n > 512)] += 1
    assert Counter(map(tuple, count_tokens(docs, BYTE).collect())) == want
    assert count_tokens(none, BYTE).collect() == []


def test_units_equal_the_library():
    """Random strings of awkward characters, and every code point that the fast way takes."""
    from rondelle.llm.tokens import UNSURE, Units, load

    rnd = random.Random(1)
    some = "aB é  \n\t!?'s12 ıİ́あ’ﬁ\x1c\x85 Σςа²½Ⅷ'LL ñ"
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randrange(25))) for _ in range(4000)] + ["<|endoftext|>a", "x\n <|endoftext|>"]
    texts += [f"a{c}b {c}{c} 1{c}Z{c}" for c in map(chr, range(0x3100)) if not UNSURE.search(c)]
    for path in (WORD, BYTE):
        units, tok = Units(path), load(path)
        for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(units.encode(t), "<u4").tolist() == e.ids, ascii(t)


def test_quality(spark, docs, none):
    from rondelle.llm.quality import beta_strength, score, with_quality

    labels = spark.createDataFrame([(3 * i, i % 2, None) for i in range(30)] + [(None, 1, 0), (6, None, 0), (9, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = with_quality(docs, labels)
    assert [c for c in docs.columns if c != "kept"] + ["document_p", "site_p", "quality_p", "kept"] == got.columns
    got = got.collect()
    assert len(got) == len(rows()) and all(0 <= r["quality_p"] <= 1 for r in got)
    assert len(score(docs, labels.where("false")).collect()) == len(rows())
    assert score(none, labels).collect() == []
    assert beta_strength(0.5, 0.0, 0.1) == 1e4


def test_quality_shrinks_and_holds_out(spark):
    """Sparse sites stay near the global share; on held-out labels the classifier is right."""
    from rondelle.llm.quality import score

    rnd = random.Random(4)
    good = lambda: " ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(2, 8))) for _ in range(60)) + "."
    bad = lambda: " ".join(f"W{rnd.randrange(99)}$$$" for _ in range(60))
    given = [(i, bad() if i % 4 == 0 else good(), "en", "big" if i else "one", 0) for i in range(400)]
    docs = spark.createDataFrame(given, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 3)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in score(docs, labels).collect()}
    assert all(got[i]["kept"] == (i % 4 > 0) for i in range(400))
    assert abs(got[0]["site_p"] - 0.75) < 0.05


@pytest.mark.parametrize("few", [100_000, 2])
def test_quality_equals_numpy(spark, docs, monkeypatch, few):
    """Posteriors and combined odds against numpy, from the documents' own probabilities; by broadcast and by split join."""
    from rondelle.llm import quality

    monkeypatch.setattr(quality, "FEW_SITES", few)
    labels = spark.createDataFrame([(3 * i, int(i % 3 > 0)) for i in range(45)], "doc_id bigint, quality int")
    got = quality.score(docs, labels).collect()
    mean, scale, w, base = quality.train(docs, labels)
    assert len(got) == len(rows())
    # each row's own probability, from its features
    feats = docs.select("doc_id", "source", "lang", quality.features(quality.text_or_empty()).alias("x")).collect()
    limit = lambda v: min(max(v, base - quality.EVIDENCE), base + quality.EVIDENCE)
    odds = [limit(float((np.array(r["x"]) - mean) / scale @ w[:-1] + w[-1])) for r in feats]
    p = [1 / (1 + np.exp(-o)) for o in odds]
    hosts, paths = defaultdict(list), defaultdict(list)
    for r, q in zip(feats, p, strict=True):
        hosts[r["source"]].append(q)
        paths[r["source"], r["lang"]].append(q)
    mu = min(max(sum(p) / len(p), 1e-4), 1 - 1e-4)
    strength = lambda v, noise: min(max(mu * (1 - mu) / max(v - noise, 1e-6) - 1, 1.0), 1e4)
    spread = mu * (1 - mu)
    top = strength(np.mean([(np.mean(h) - mu) ** 2 for h in hosts.values()]), spread * np.mean([1 / len(h) for h in hosts.values()]))
    low = strength(np.mean([(np.mean(v) - np.mean(hosts[h])) ** 2 for (h, _), v in paths.items()]), spread * np.mean([1 / len(v) for v in paths.values()]))
    want = []
    for r, q, o in zip(feats, p, odds, strict=True):
        h, v = hosts[r["source"]], paths[r["source"], r["lang"]]
        at_host = (mu * top + sum(h) - q) / (top + len(h) - 1)
        site = min(max((at_host * low + sum(v) - q) / (low + len(v) - 1), 1e-4), 1 - 1e-4)
        both = 1 / (1 + np.exp(base - o - np.log(site / (1 - site))))
        want.append((r["doc_id"], r["source"], r["lang"], q, site, both, both >= quality.KEEP_FROM))
    key = lambda r: (str(r[:3]), r[3], r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and np.allclose(a[3:6], b[3:6], rtol=0, atol=1e-9) and a[6] == b[6]
