"""Each operator against brute force, a round trip or held-out rows, on small inputs with the defined odd cases."""

import collections
import hashlib
import re
import string
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillon.llm")
from quillon.llm import fingerprints, jaccard, langid, packing, pieces, pitmanyor, quality, queries, suffixes, toxicity, webarchive  # noqa: E402

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Null, empty and blank texts, ties, repeated rows, a long text, odd characters.
ODD = [
    (1, None, "en", "s1"), (2, "", "en", "s1"), (3, " \n\t ", None, None), (4, "A b  c\n\nd é€𝄞 <|endoftext|> ", "fr", "s2"), (5, "same text here again", "en", "s2"),
    (5, "same text here again", "en", "s2"), (6, "same text here again", "en", "s3"), (7, "word " * 3000, "en", "s3"), (8, "x" * 9000, "de", "s1"), (None, "a null id has this text", "en", "s1"), (9, "١٢   \x1c tail ", "es", "s4"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("score", F.lit(1)).withColumn("block", F.lit("b")).withColumn("n", F.lit(0)).withColumn("host", F.lit(None).cast("int"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").limit(120).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def check_pieces(rows, pairs):
    t = encoder()
    want = collections.Counter()
    for doc_id, text in pairs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    sequences, whole = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id, r.doc_tokens].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.SEQUENCE
    for (doc_id, n), parts in whole.items():
        copies = sum(c for (d, m, _), c in want.items() if (d, m) == (doc_id, n))
        assert sum(p.length for p in parts) == n * copies
        for p in parts:
            assert 0 <= p.start and p.start + p.length <= n
    return sequences


def test_packing(spark, odd, docs, none):
    for df in (odd, docs):
        rows = packing.pack_documents(df, queries.tokenizer_path(), with_ids=True).collect()
        sequences = check_pieces(rows, texts(df))
        padding = sum(0 if (n := sum(x for _, x in p)) & (n - 1) == 0 else packing.SEQUENCE - n for p in sequences.values())
        assert padding == 0
        t = encoder()
        by_doc = dict(texts(df))
        for r in rows:
            ids = [*t.encode(by_doc[r.doc_id] or "", add_special_tokens=False).ids, 1][r.start : r.start + r.length]
            assert list(r.ids) == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert packing.pack_documents(none, queries.tokenizer_path()).count() == 0


def test_packing_of_whole_examples(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(1, 1200)), 0) for i in range(400)] + [(1000, 5000, 10), (1001, None, None)]
    df = spark.createDataFrame([(i, n, None if n is None else n // 2) for i, n, _ in rows], "example_id long, tokens long, loss_tokens long")
    got = packing.pack_examples(df, limits=(2048, 4, 900)).collect()
    assert len(got) == len(rows)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append(r)
    for b in bins.values():
        if not b[0].oversize:
            assert sum(r.tokens for r in b) <= 2048 and len(b) <= 4 and sum(r.loss_tokens for r in b) <= 900


def test_pieces_equal_the_library(spark, odd, docs, none):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (odd, docs.limit(30)):
        got = pieces.encode(df, path, with_ids=True)
        rows = got.collect()
        by_doc = dict(texts(df))
        assert len(rows) == df.count()
        for r in rows:
            assert list(r.ids) == m.encode(by_doc[r.doc_id] or "") and r.round_trip
        back = {r.doc_id: r.text for r in pieces.decode(got.where("doc_id is not null").dropDuplicates(["doc_id"]), path).collect()}
        assert all((by_doc[i] or "") == t for i, t in back.items())
    assert pieces.encode(none, path).count() == 0


def test_folded_merges_equal_the_library(spark):
    """Words of one long and of an array of cuts, made of pieces so that many merges compete."""
    import random

    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    m, model, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path), random.Random(3)
    some = [p.replace(pieces.MARK, "") for p in model.pieces.values()]
    words = ["".join(rng.choice(some) for _ in range(rng.choice([1, 2, 3, 5, 30]))) for _ in range(1500)] + ["a" * 61, "a" * 62, "ab" * 400, "x", "𝄞", "é\x1c٣" * 40]
    words = [w for w in words if w and pieces.MARK not in w and len(w.split(" ")) == 1]
    given = spark.createDataFrame([(k, pieces.MARK + w, len(w) < pieces.SHORT) for k, w in enumerate(words)], "k int, word string, short boolean")
    found = {r.k: r.path for r in pieces.word_paths(given, model, ["k", "short"], F.col("short")).collect()}
    for k, ids in enumerate(spelled(model, [pieces.MARK + w for w in words], found)):
        assert ids == m.encode(words[k]), words[k]


def spelled(model, words, found):
    owner = np.repeat(np.array(sorted(found), np.int64), [len(found[k]) for k in sorted(found)])
    edges = np.array([e for k in sorted(found) for e in found[k]], np.int64)
    flat, n = pieces.Speller(model).ids(words, owner, edges)
    return [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]


def test_merge_ranks_of_large_models():
    """Of abc the bc is merged first, whatever ranks the words beside it have."""
    edge = lambda rank, start: rank << 43 | start << 27 | 2 << 20
    edges = np.array([edge(1_000_000, 0), edge(40_000, 1), edge(3, 0), edge(1, 1), edge(70_000, 0), edge(65_536, 1)], np.int64)
    assert pieces.merged(np.array([0, 0, 1, 1, 2, 2]), edges).tolist() == [False, True] * 3


def test_a_word_of_many_blocks_is_encoded_once(spark, monkeypatch):
    """The lattice gets each distinct word of the corpus once, and every text its own words' ids back."""
    import sentencepiece

    path, text = queries.tokenizer_path("piece_bpe_32k.model"), "the same words  in every▁block " + "é" * 70
    docs = spark.createDataFrame([(i, text if i % 3 else f"{text} number{i % 7}") for i in range(60)], "doc_id long, text string").repartition(5)
    seen, plain = [], pieces._bucket_words
    monkeypatch.setattr(pieces, "_bucket_words", lambda states: seen.append(plain(states)) or seen[0])
    m, given = sentencepiece.SentencePieceProcessor(model_file=path), dict(texts(docs))
    for r in pieces.encode(docs, path, with_ids=True).collect():
        assert list(r.ids) == m.encode(given[r.doc_id]) and r.round_trip
    words = [r.word for r in seen[0].collect()]
    assert len(words) == len(set(words)) == len({w for t in given.values() for w in pieces.words_of_text(t)})


def test_viterbi_is_the_best_path(spark):
    model = pieces.PieceModel(queries.tokenizer_path("piece_bpe_32k.model"))
    words = ["▁the", "▁word𝄞s", "▁abcdefgh", "▁"]
    model.merges = False
    given = spark.createDataFrame(list(enumerate(words)), "k int, word string")
    found = {r.k: r.path for r in pieces.word_paths(given, model, ["k"], F.lit(True)).collect()}
    rows = dict(zip(words, spelled(model, words, found), strict=True))
    table = {p: (i, model.scores[i]) for i, p in model.pieces.items()}
    for w in words:
        best = [(0.0, [])] + [(-1e300, None)] * len(w)
        for e in range(1, len(w) + 1):
            for s in range(max(0, e - model.longest), e):
                p = table.get(w[s:e], (-1, pieces.UNKNOWN_SCORE) if e - s == 1 else None)
                if p and best[s][0] + p[1] > best[e][0]:
                    best[e] = (best[s][0] + p[1], best[s][1] + [p[0]])
        want = []
        for i, c in zip(best[-1][1], [x for i, x in _with_texts(best[-1][1], w, model)], strict=True):
            want += [i] if i >= 0 else [model.bytes[b] for b in c.encode()]
        assert rows[w] == want


def _with_texts(ids, word, model):
    at = 0
    for i in ids:
        n = len(model.pieces[i]) if i >= 0 else 1
        yield i, word[at : at + n]
        at += n


def test_forward_backward(spark):
    rng = np.random.default_rng(0)
    energy, transition, counts = rng.normal(size=(300, 3)), rng.normal(size=(3, 3)), np.array([1, 64, 65, 170])
    gamma, pairs = langid.posteriors(energy, counts, transition, pairs=True)
    at, expected = 0, np.zeros((3, 3))
    for c in counts:
        e, m = np.exp(energy[at : at + c]), np.exp(transition)
        a, b = np.zeros((c, 3)), np.ones((c, 3))
        now = np.full(3, 1 / 3)
        for k in range(c):
            now = (now @ m) * e[k]
            now /= now.sum()
            a[k] = now
        for k in range(c - 2, -1, -1):
            b[k] = m @ (e[k + 1] * b[k + 1])
            b[k] /= b[k].sum()
        g = a * b
        assert np.allclose(g / g.sum(1, keepdims=True), gamma[at : at + c])
        for k in range(1, c):
            j = a[k - 1][:, None] * m * (e[k] * b[k])[None]
            expected += j / j.sum()
        at += c
    assert np.allclose(pairs, expected)


def test_languages(spark, odd, docs, none):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = langid.train(docs, ~held)
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.9 and all(0 <= r.score <= 1 for r in rows)
    found = langid.identify(odd, model).collect()
    assert len(found) == len(ODD)
    assert {r.lang_pred for r in found if r.doc_id in (1, 2, 3)} == {"und"}
    kept = langid.filter_languages(odd, model)
    assert kept.columns == odd.columns and kept.where("doc_id in (1, 2, 3)").count() == 0
    assert langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.limit(3), langid.train(none, F.lit(True))).collect()} == {"und"}


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_pitman_yor_counts(which, request):
    df = request.getfixturevalue(which)
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    rows = pitmanyor.score_texts(df, learn).collect()
    pairs = texts(df)
    tokens = [WORD.findall((t or "").translate(LOWER)) + [""] for _, t in pairs]
    counts = collections.Counter(w for (i, _), ws in zip(pairs, tokens, strict=True) if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, _), ws in zip(pairs, tokens, strict=True))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(np.isfinite(r.score) and r.score <= 1e-6 for r in rows)
    if which == "docs":
        held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_pitman_yor_contexts_are_whole_words(spark):
    rows = [(k, "the oneab red" if k % 2 else "the twoab blue") for k in range(40)] + [(100, "the oneab red"), (101, "the oneab blue"), (102, "the twoab blue"), (103, "the twoab red")]
    found = pitmanyor.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 100).collect()
    score = {r.doc_id: r.score for r in found}
    assert score[100] > score[101] + 0.5 and score[102] > score[103] + 0.5


def test_pitman_yor_restaurants_grow_with_the_words():
    block = pitmanyor.Block()
    block.add([1], [" ".join(f"w{k:05d}ab same" for k in range(3000))], [True])
    asks, _ = block.question(1)
    low, high = pitmanyor.unpack(asks[0][1])[3:5]
    contexts = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
    assert len(set(contexts.tolist())) == 3002  # the words, `same` and the end


def test_pitman_yor_messages_grow_with_the_buckets(spark, monkeypatch):
    """A sweep's rows are in proportion to the buckets, not to their square, and each bucket gets all its totals back."""
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 60) % 3000)) for i in range(200)]
    docs, made, keep = spark.createDataFrame(rows, "doc_id long, text string"), [], pitmanyor.staged

    def counted(df, name, *more):
        out = keep(df, name, *more)
        if name == "lm-sweep":
            made.append(out.count())
        return out

    def scores(buckets):
        monkeypatch.setattr(pitmanyor, "shuffle_parts", lambda spark: buckets)
        return {r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 6), r.score) for r in pitmanyor.score_texts(docs, F.col("doc_id") % 5 != 0, burn_in=1, samples=1).collect()}

    monkeypatch.setattr(pitmanyor, "staged", counted)
    few, many = scores(4), scores(32)
    assert made[2] == made[3] <= 8 * made[0]
    assert {i: r[:3] for i, r in few.items()} == {i: r[:3] for i, r in many.items()} and len(many) == 200
    # With more owners than buckets the messages are others, and the totals, so the scores, the same.
    monkeypatch.setattr(pitmanyor, "MOST", 100)
    assert scores(4) == few and made[4] > 2 * made[0]


def test_pitman_yor_without_rows(none):
    assert pitmanyor.score_texts(none, F.lit(True)).count() == 0


def test_reseating_keeps_its_bounds():
    rng = np.random.default_rng(0)
    c = np.array([0, 1, 2, 5, 50, 5000, 2_000_000])
    t = pitmanyor.reseat(c, 0.6, np.full(len(c), 3.0), rng)
    assert (t <= c).all() and (t[c > 0] >= 1).all() and t[0] == 0


def exact_tables(customers, discount, new):
    """The chance of each number of tables, customer by customer."""
    p, t = np.zeros(customers + 2), np.arange(customers + 2)
    p[1] = 1
    for k in range(1, customers):
        q = np.where((t > 0) & (t <= k), new / (new + k - discount * np.minimum(t, k)), 0)
        p, more = p * (1 - q), (p * q)[:-1]
        p[1:] += more
    return p


@pytest.mark.parametrize(("customers", "discount", "new"), [(25, 0.7, 0.5), (200, 0.9, 50.0), (400, 0.5, 400.0), (300, 0.7, 1e5), (400, 0.1, 1.0), (600, 0.72, 20.0)])
def test_reseating_of_many_customers_is_exact(customers, discount, new):
    runs, p = 20_000, exact_tables(customers, discount, new)
    # Dishes of other sizes lie between, as rounds are of all dishes at once.
    c, w = np.array([customers, 3, 90] * runs), np.array([new, 2.0, 7.0] * runs)
    t = pitmanyor.reseat(c, discount, w, np.random.default_rng(3))[::3]
    often = p * runs > 10
    found = np.bincount(t, minlength=len(p))
    assert ((found - runs * p)[often] ** 2 / (runs * p[often])).sum() < often.sum() + 5 * np.sqrt(2 * often.sum())
    assert abs(t.mean() - (p * np.arange(len(p))).sum()) < 5 * t.std() / np.sqrt(runs)


def test_reseating_takes_few_rounds():
    """A dish of many tables takes rounds by the logarithm of its customers, not one for each table."""
    rng, calls = np.random.default_rng(0), []

    class Counted:
        def random(self, n):
            calls.append(n)
            return rng.random(n)

    t = pitmanyor.reseat(np.array([3, 400_000, 50]), 0.7, np.array([1.0, 5000.0, 1.0]), Counted())
    assert t[1] > 20_000 and len(calls) < 200 and sum(calls) < 4 * t[1]


def test_pitman_yor_blocks_have_the_words_of_the_texts():
    from quillon.llm.common import words_of

    rng = np.random.default_rng(0)
    odd = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\x00", "a", "A", "Z", "É", "é", "İ", "K", "𝄞"]
    for texts in ([None], ["", " "], ["a"], *([None, "", "".join(rng.choice(odd, rng.integers(0, 30))), " x ", "".join(rng.choice(odd, 9))] for _ in range(100))):
        block = pitmanyor.Block()
        for some in (texts[:2], texts[2:]):
            block.add([1] * len(some), some, [True] * len(some))
        words, tokens, counts = block.tokens()
        want = [[*words_of(t), b""] for t in texts]
        assert [words[k] for k in tokens] == [w for ws in want for w in ws] and counts.tolist() == [len(ws) for ws in want]
        assert len(set(words)) == len(words)


def brute_components(pairs, size, num, den):
    sets = []
    for _, text in pairs:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and den * both >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(s), str(least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(pairs, sets, strict=True)))


def near_copies(spark):
    rng = np.random.default_rng(7)
    base = [f"w{k}" for k in rng.integers(0, 500, 120)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 8)):
            words[k] = f"e{rng.integers(0, 50)}"
        rows.append((i, " ".join(words[: rng.integers(90, 121)])))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("which", ["odd", "near"])
def test_jaccard_components(spark, which, odd):
    df = odd if which == "odd" else near_copies(spark)
    got = jaccard.jaccard_components(df, chunk=7).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(texts(df), 4, 85, 100)


def test_jaccard_of_nothing(none):
    assert jaccard.jaccard_components(none).count() == 0


def test_signatures_never_miss_a_similar_pair():
    rng = np.random.default_rng(2)
    bands = jaccard.Bands(85, 100)
    for n in (3, 7, 12, 20, 33, 60, 150, 400):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop = rng.integers(0, max(1, int(0.081 * n)) + 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, rng.integers(0, max(1, int(0.07 * n)) + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if jaccard.similar(len(a), len(b), both, 85, 100):
                assert len(np.intersect1d(bands.signatures(a), bands.signatures(b)))


def test_archives(spark, tmp_path):
    page = "<p>" + "x" * 200
    rows = [(3, "http://a", page), (1, None, page), (2, "u\nv", None), (7, "http://b", "short"), (8, "http://b", "short"), (9, "http://c", "é" * 80), (1, None, page), (None, "n", "z" * 300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = webarchive.archive_and_read(df).collect()
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = h == page and i != 1
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", str(1 if again else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    assert all(r.intact for r in got if r.record_type == "response")
    assert webarchive.archive_and_read(df.where("page_id = 99")).count() == 0


@pytest.mark.parametrize("own", [True, False])
def test_zip_reader(tmp_path, own):
    path = tmp_path / "a.zip"
    if own:
        with path.open("wb") as f:
            w = webarchive.PackageWriter(f.write)
            for name, data in (("a/é.txt", b"hello" * 1000), ("b", b"")):
                w.begin(name)
                w.add(data)
                w.end()
            w.close()
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and z.read("a/é.txt") == b"hello" * 1000
    else:
        with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
            z.comment = b"PK\x05\x06 not the end"
            z.writestr("a/é.txt", b"hello" * 1000)
            z.writestr("b", b"")
            z.writestr("packed", b"1" * 999, zipfile.ZIP_DEFLATED)
    data = path.read_bytes()
    p = webarchive.Package(lambda n, at: data[at : at + n], len(data))
    start = p.start("a/é.txt")
    assert data[start : start + p.members["a/é.txt"].size] == b"hello" * 1000 and p.members["b"].size == 0
    if not own:
        with pytest.raises(ValueError, match="compressed"):
            p.start("packed")
    with pytest.raises(ValueError, match="not a ZIP"):
        webarchive.Package(lambda n, at: b"x" * n, 500)


def test_archives_are_located_by_the_directory(spark, tmp_path):
    """Two archives in one package: an index out of order for one, none for the other."""
    import json

    records = [webarchive.record(i, f"http://{i}", (f"page {i} " * 30).encode(), hashlib.sha256((f"page {i} " * 30).encode()).hexdigest(), None) for i in range(6)]
    path = tmp_path / "two.zip"
    with path.open("wb") as f:
        w = webarchive.PackageWriter(f.write)
        w.begin("archive/first.warc")
        w.add(b"".join(records[:3]))
        w.end()
        w.begin("other/notes.txt")
        w.add(b"nothing")
        w.end()
        w.begin("archive/second.warc")
        w.add(b"".join(records[3:]))
        w.end()
        w.begin("indexes/some.cdxj")
        at = [0, len(records[0]), len(records[0]) + len(records[1])]
        w.add(b"!meta line without an entry\n" + b"\n".join(f"k {json.dumps({'filename': 'first.warc', 'offset': at[k], 'length': len(records[k])})}".encode() for k in (2, 0, 1)))
        w.end()
        w.close()
    packages = spark.createDataFrame([(str(path),)], "path string")
    got = webarchive.read_archives(spark, packages, str(tmp_path), with_payload=True).collect()
    assert sorted(r.page_id for r in got) == list(range(6)) and all(r.intact and bytes(r.payload) == f"page {r.page_id} ".encode() * 30 for r in got)
    data = path.read_bytes().replace(b"page 4 page", b"page 4 PAGE")  # stored bytes changed: the figures are those of the bytes
    path.write_bytes(data)
    bad = {r.page_id: r for r in webarchive.read_archives(spark, packages, str(tmp_path)).collect()}
    assert not bad[4].intact and bad[5].intact and bad[4].payload_digest == hashlib.sha256(("page 4 " * 30).replace("page 4 page", "page 4 PAGE").encode()).hexdigest()


def test_digests(spark, odd, docs, none):
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = {r.doc_id: r for r in fingerprints.compare_with_next(df.repartition(3)).collect()}
        pairs = sorted((i, t or "") for i, t in texts(df))
        assert len(rows) == len(pairs)
        for (i, t), (_, following) in zip(pairs, pairs[1:] + pairs[:1], strict=True):
            edited = fingerprints.edited_text(t, following)
            r = rows[i]
            assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.digest(t.encode()))
            assert r.near_next == fingerprints.likeness(r.fingerprint, fingerprints.digest(following.encode())) and 0 <= r.near_edited <= 1
    assert fingerprints.compare_with_next(odd).count() == len(ODD) and fingerprints.compare_with_next(none).count() == 0
    assert fingerprints.difference("00" * 66, "00" * 66) == 0


def test_toxicity_grammar(spark, odd, docs, none):
    g = toxicity.Grammar({"idiot$": 3.0, "moron": 2.0})
    at = lambda t: {k: v for k, v in zip(toxicity.FEATURES, g.read(t) or [], strict=False) if v and k in toxicity.PATTERNS}
    assert list(at("You are an idiot.")) == ["insult+"] and list(at("It is not an idiot")) == ["insult~"]
    assert list(at('He said the morons left')) == ["insult'+"] and at("idiotic words") == {} and g.read(None) is None
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    every = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(every, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.train(every, labels.limit(0))
    assert toxicity.score(docs, empty).count() == docs.count()


def test_toxicity_grammar_by_loops():
    """Random clauses against a reading of the rules without machines."""
    import random

    rng = random.Random(5)
    g = toxicity.Grammar({"idiot$": 3.0, "moron": 2.0})
    words = ["idiot", "idiots", "morons", "kill", "you", "not", "said", "tree", "house", "very"]
    for _ in range(800):
        clauses = [[rng.choice(words) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 3))]
        want = dict.fromkeys(toxicity.FEATURES, 0.0)
        for c in clauses:
            hits = [(k, "threat", 0.0) if w == "kill" else (k, "insult", 3.0 if w == "idiot" else 2.0) for k, w in enumerate(c) if w in ("idiot", "morons", "kill")]
            for k, kind, weight in hits:
                want[kind + "~" * ("not" in c[max(0, k - 3) : k]) + "'" * ("said" in c) + "+" * ("you" in c)] += 1
                want["weight"] += weight
                want[f"any_{kind}"] = 1.0
            want["clauses"] += bool(hits)
        got = g.read(". ".join(" ".join(c) for c in clauses))
        assert (got or [0.0] * len(want)) == pytest.approx([np.log1p(v) for v in want.values()]), clauses


def test_toxicity_prefilter_has_the_grammar_s_word_borders():
    g = toxicity.Grammar({"idiot": 3.0})
    marks = [chr(c) for c in range(0x3000) if not re.match(r"[^\W\d_]", chr(c))]
    for m in marks:
        assert g.read(f"uno {m}Idiota{m}")[toxicity.FEATURES.index("any_insult")] > 0, hex(ord(m))
        assert g.read(f"uno {m}kill{m}")[toxicity.FEATURES.index("any_threat")] > 0, hex(ord(m))
    assert g.read("¡Idiota!") and g.read("“kill”") and g.read("kill…") and g.read("«\u00a0idiot\u00a0»") and g.read("they said—kill")
    assert g.read("éidiot killé ¡Hola!") is None


def test_quality_measures(spark, odd, docs, none):
    for df in (odd, docs):
        rows = collections.Counter(tuple(r)[:7] for r in quality.quality_rules(df).collect())
        want = collections.Counter()
        for i, text in texts(df):
            t = text or ""
            w = WORD.findall(t)
            windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
            covered = {p for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
            lines = [x for x in t.split("\n") if WORD.search(x)]
            failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
            want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed] += 1
        assert rows == want
    assert quality.quality_rules(none).count() == 0
    kept = quality.filter_quality(odd)
    assert kept.columns == odd.columns and kept.count() <= odd.count()


def test_watched_hosts_lose_the_documents_that_fail(spark):
    """A host with many repeated lines loses those documents only; a single such document elsewhere stays."""
    good = " ".join(f"w{k}" for k in range(40))
    lines = "\n".join(f"a{k} b{k}" for k in range(12)) + "\na1 b1\na5 b5\na2 b2\na9 b9"
    rows = [(i, lines if i % 3 == 0 else good, "en", "mirror") for i in range(200)] + [(1000 + i, lines if i == 7 else good, "en", f"h{i % 5}") for i in range(2000)]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == (i % 3 != 0) for i in range(200)) and all(got[1000 + i] for i in range(2000))


def test_bad_hosts_take_their_documents(spark):
    good = " ".join(f"w{k}" for k in range(40))
    rows = [(i, "bad" if i % 10 else good, "en", "spam") for i in range(200)] + [(1000 + i, good, "en", f"h{i % 5}") for i in range(300)]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[i] for i in range(200)) and all(got[1000 + i] for i in range(300))


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_repeated_passages(which, request):
    df = request.getfixturevalue(which)
    df = df if which == "odd" else df.limit(60)
    rows = collections.Counter(tuple(r) for r in suffixes.removal_digests(df).collect())
    pairs = sorted(((i if i is not None else 2**63, (t or "").encode(), i) for i, t in texts(df)), key=lambda p: p[:2])
    least = {}
    for i, b, _ in pairs:
        for k in range(len(b) - 49):
            least.setdefault(b[k : k + 50], i)
    want = collections.Counter()
    for i, b, own in pairs:
        mark = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < i:
                mark[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        want[own, len(b), sum(mark), sum(m and (k == 0 or not mark[k - 1]) for k, m in enumerate(mark)), hashlib.sha256(kept).hexdigest()] += 1
    assert rows == want


def test_passages_of_nothing(none):
    assert suffixes.removal_digests(none).count() == 0


def test_pitman_yor_groups_are_small(spark):
    import pyarrow as pa
    import zstandard

    from quillon.llm.common import small_batches
    from quillon.llm.pitmanyor import _questions, pack, unpack

    # A packed text is in no bucket's group, and every text has a group of its own.
    docs = spark.createDataFrame([(i, f"some words {i}", True) for i in range(60)], "id long, text string, learn boolean").repartition(3)
    rows = _questions(docs, 4).select("kind", "key").collect()
    asks, texts = ({r.key for r in rows if r.kind == k} for k in ("ask", "text"))
    assert asks <= set(range(4)) and min(texts) >= 4 and len(texts) == sum(r.kind == "text" for r in rows) == 3
    # Numbers are packed byte by byte of their places, shorter than one after another, and come back as they were.
    numbers = np.random.default_rng(0).integers(0, 70_000, 50_000).astype("<u4")
    assert len(pack(numbers)) < 0.9 * len(zstandard.ZstdCompressor(level=1).compress(numbers.tobytes()))
    given = [numbers, np.zeros(0, "<u2"), np.array([-1, 1 << 40], "<i8"), np.array([0.5, -2], "<f4")]
    for a, b in zip(given, unpack(pack(*given)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()
    # A group goes to Python in several batches, and the setting is as before afterwards.
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    wide = spark.range(400).select(F.lit(0).alias("k"), F.repeat(F.lit("x"), 100).alias("t"))
    with small_batches(spark, 2000):
        assert wide.groupBy("k").applyInArrow(lambda t: pa.table({"n": [t.column("t").num_chunks]}), "n long").first().n > 5
    assert spark.conf.get(key) == before
