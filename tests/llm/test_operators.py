"""Each operator against a brute-force version, on the small tables and on planted cases."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from dialogue_factors.llm import bitplanes, jaccard_join, kneser_ney, suffix_dedup, tokens
from dialogue_factors.llm.decontaminate import find_leaks
from dialogue_factors.llm.invertible_sketch import differences, estimate, fingerprints, signed, sketch, subtract
from dialogue_factors.llm.kneser_ney import classify, fit, log_probabilities, ngram_keys, worst_family, _shard
from dialogue_factors.llm.lookup_shards import assign_shards, fill_table, moved_rows
from dialogue_factors.llm.mixture_language import predict_languages
from dialogue_factors.llm.packing import binary_lengths, pack_powers_of_two
from dialogue_factors.llm.queries import QUERIES
from dialogue_factors.llm.secret_forest import find_secrets, redact
from dialogue_factors.llm.tokens import default_tokenizer

SCHEMA = "doc_id long, text string, token string, start long, n long, lang string, source string, n_chars long, bucket int"
ODD = [
    (1000001, None), (1000002, ""), (1000003, " \n\t "), (1000004, "a"), (1000004, "a"), (None, "no id here, but some words to read."), (1000005, "Ünïcödé — “quotes” 中文 🙂 it's 42 <|endoftext|>"),
    (1000006, "same words again " * 2000), (1000007, "x" * 70_000), (1000008, "tie"), (1000009, "tie"), (-3, "negative id"),
]


def documents(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(i, t, "t", 7, 8, "en", "src", len(t) if t is not None else None, 1) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def small(spark, data, name="documents"):
    return spark.read.parquet(f"{data}/{name}.parquet")


def texts(spark, data):
    return [(r.doc_id, r.text) for r in small(spark, data).select("doc_id", "text").collect()] + ODD


def by_text(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(tokenizer, text, end):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.mark.parametrize("remembered", [300_000, 50, 0])
def test_word_encoder(tokenizer, monkeypatch, remembered):
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    draw = random.Random(5)
    words = [t for _, text in ODD for t in (text or "").split()] + ["don't", "stop...", "İstanbul", "e\u0301", "ﬁ½", "a1b2", "!!", "(x)", "a\u2028b", "w" * 100]
    words += ["".join(draw.choices("abcdeéß", k=6)) + draw.choice(["", ".", ",)"]) for _ in range(300)]
    encoder = tokens.WordEncoder(default_tokenizer())
    for size in (0, 1, 40, 200, 40):
        rows = [draw.choice([None, "", " ", "<|endoftext|> b", "a<|"]) if i % 5 == 0 else " ".join(draw.choices(words, k=size)) for i in range(size)]
        flat, offsets = encoder.encode(pa.array(rows, pa.string()))
        assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [tokenizer.encode(r or "", add_special_tokens=False).ids for r in rows]


def test_packing(spark, data, tokenizer):
    rows = texts(spark, data)
    packed = pack_powers_of_two(documents(spark, rows)).collect()
    expected = []
    for doc_id, text in rows:
        ids, at = ids_of(tokenizer, text, 2), 0
        for n in binary_lengths(len(ids), 4096):
            expected.append((doc_id, at, n, zlib.crc32(ids[at:at + n].tobytes()), len(ids)))
            at += n
        assert at == len(ids)
    assert by_text((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed) == by_text(expected)
    assert sorted(r.sequence_id for r in packed) == list(range(len(packed)))
    ordered = [r.length for r in sorted(packed, key=lambda r: r.sequence_id)]
    assert ordered == sorted(ordered, reverse=True) and {r.offset for r in packed} == {0}
    assert pack_powers_of_two(documents(spark, [])).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_bit_planes(spark, data, tokenizer, bits, tmp_path):
    rows = texts(spark, data)
    got = bitplanes.write_and_read(documents(spark, rows), str(tmp_path / "ids"), bits=bits, block_ids=1000).collect()
    order = sorted(rows, key=lambda r: -(1 << 62) if r[0] is None else r[0])
    expected, start = [], 0
    for doc_id, text in order:
        ids = ids_of(tokenizer, text, 1)
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert by_text(tuple(r) for r in got) == by_text(expected)
    ids = np.random.default_rng(1).integers(0, 1 << 32, 777, dtype=np.uint32)
    assert (bitplanes.from_planes(bitplanes.to_planes(ids, bits), 777) == ids).all()
    assert bitplanes.write_and_read(documents(spark, []), str(tmp_path / "none")).count() == 0


def test_suffix_dedup(spark, data, monkeypatch):
    draw = random.Random(3)
    base = "".join(draw.choice("abcdefgh \n") for _ in range(3000))
    rows = texts(spark, data)[-80:]
    for i in range(40):
        text = list(base)
        for _ in range(draw.randint(0, 10)):
            text[draw.randrange(3000)] = "é"
        cut = draw.randint(0, 1500)
        rows.append((1000 + i, "".join(text)[cut:cut + draw.randint(100, 1500)]))
    rows += [(2000, "ab" * 150), (2001, "x" * 199), (2002, "y" * 200), (2003, "z" * 201)]
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[p:p + 200] for _, b in raw for p in range(len(b) - 199))
    expected = []
    for d, b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - 199):
            if seen[b[p:p + 200]] > 1:
                gone[p + 1:p + 201] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        expected.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    for piece in (suffix_dedup.PIECE, 5000):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        assert by_text(tuple(r) for r in suffix_dedup.remove_repeats(documents(spark, rows)).collect()) == by_text(expected)
    words = np.random.default_rng(2).integers(0, 3, (9000, 3))
    assert (words[suffix_dedup.multikey_quicksort(words, 16)] == words[np.lexsort(words.T[::-1])]).all()
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


def pieces(text):
    return {m for p in re.split(r"\n+", text) for m in re.findall(r"\S+(?:\s+\S+){0,15}", p)}


def test_fingerprints(spark, data):
    long = "\n".join(f"paragraph {i} of a very long text" for i in range(3000))
    rows = texts(spark, data) + [(1000010, long), (1000011, long.replace("paragraph 7 ", "another 7 "))]
    rows = [r for r in rows if r[0] != 1000004]
    rows = sorted(rows, key=lambda r: -(1 << 62) if r[0] is None else r[0])
    rows = [r for i, r in enumerate(rows) if i == 0 or r[0] != rows[i - 1][0]]
    got = {r.doc_id: r for r in fingerprints(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for (d, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        t, following, r = t or "", following or "", got[d]
        edited = t[:len(t) - len(t) // 2] + following[:len(t) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - like(pieces(t), pieces(edited))) < 1e-9
        assert abs(r.near_next - like(pieces(t), pieces(following))) < 1e-9
        assert (r.edited_lost, r.edited_gained) == (len(pieces(t) - pieces(edited)), len(pieces(edited) - pieces(t)))
    assert got[1000008].fingerprint == got[1000009].fingerprint and got[1000008].near_next == 1.0
    assert fingerprints(documents(spark, [])).count() == 0
    repeated = fingerprints(documents(spark, [(1, "a b\nc"), (1, "a b\nc"), (1, "d"), (None, None), (None, None)])).collect()
    assert len(repeated) == 5 and sum(r.near_next == 1.0 for r in repeated) == 2


def test_peeled_digests(spark):
    """Peeling gives back the digests themselves, and on which side they are; the sketches
    made for a small difference of long texts have fewer cells than the texts digests."""
    draw = random.Random(5)
    rows = []
    for n, lost, gained in ((0, 0, 0), (5, 1, 1), (400, 3, 2), (400, 40, 30), (2000, 900, 0), (300, 300, 300)):
        a = [draw.getrandbits(63) for _ in range(n)]
        rows.append((a, a[lost:] + [draw.getrandbits(63) for _ in range(gained)]))
    pairs = spark.createDataFrame(rows, "a array<long>, b array<long>")
    sa, sb = (sketch(signed(F.col(x), 1)) for x in "ab")
    got = pairs.select("a", "b", differences(F.col("a"), F.col("b"), sa, sb).alias("d"), estimate(subtract(sa, sb), F.col("a"), F.col("b")).alias("e")).collect()
    for r in got:
        assert sorted(k for n, k in r.d if n == 1) == sorted(set(r.a) - set(r.b))
        assert sorted(k for n, k in r.d if n == -1) == sorted(set(r.b) - set(r.a))
        assert r.e <= max(len(r.a) + len(r.b), 1) and len(r.d) <= 4 * r.e + 24
    assert 24 * got[3].e / 6 < len(got[3].a) + len(got[3].b)


def brute_components(rows):
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    sets = []
    for _, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(lower))
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= 75 * (len(a) + len(b) - common):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def test_jaccard_join(spark, data, monkeypatch):
    draw = random.Random(1)
    base = [f"w{draw.randint(0, 400)}" for _ in range(120)]
    rows = texts(spark, data)
    for i in range(200):
        words = list(base)
        for _ in range(draw.randint(0, 12)):
            words[draw.randrange(120)] = f"x{draw.randint(0, 10 ** 6)}"
        rows.append((5000 + i, "  ".join(words[draw.randint(0, 30) * (i % 3 == 0):])))
    rows += [(6000 + i, " ".join(f"y{draw.randint(0, 10 ** 6)}" for _ in range(40)) + " " + " ".join(base[:40])) for i in range(60)]
    rows += [(7000, "A b  c"), (7001, "a B c"), (7002, "a b")]
    expected = by_text(brute_components(rows))
    read = lambda: by_text((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(documents(spark, rows)).collect())
    assert read() == expected
    for name, value in (("REGION_SHINGLES", 4000), ("LEAF", 20), ("BUCKET_TOKENS", 3000)):
        monkeypatch.setattr(jaccard_join, name, value)
    assert read() == expected  # regions split by pivots
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    assert read() == expected  # and joined in tiles
    assert jaccard_join.near_duplicates(documents(spark, [])).count() == 0


def test_languages(spark, data):
    docs = small(spark, data)
    got = predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    odd = predict_languages(docs.select("doc_id", "text", "lang").unionByName(documents(spark, ODD).select("doc_id", "text", F.lit(None).cast("string").alias("lang"))))
    rows = odd.where("doc_id = 1000001 or doc_id = 1000002").collect()
    assert {r.lang_pred for r in odd.where("score = 0").collect()} == {"und"} and rows
    assert all(0 <= r.score <= 1 for r in odd.collect())
    assert {r.lang_pred for r in predict_languages(documents(spark, [(1, None)])).collect()} == {"und"}
    assert predict_languages(documents(spark, [])).count() == 0


def test_language_mixture(spark, data):
    docs = small(spark, data).select("doc_id", "text", "lang")
    some = {r.lang: r.text for r in docs.where("length(text) > 2000 and lang in ('en', 'de')").collect()}
    both = spark.createDataFrame([(-77, some["en"][:1500] + " " + some["de"][:1500], None)], docs.schema)
    row = predict_languages(docs.unionByName(both)).where("doc_id = -77").first()
    assert set(row.languages) == {"en", "de"} and min(row.languages.values()) > 0.3


def test_secrets(spark, data):
    docs = small(spark, data)
    planted = [(90_000, 'deploy with api_key = "Zx81kQ0pLm29Vb73Nc54" now'), (90_001, "commit 9fceb02d0ae598e95dc970b74767f19372d61af8 fixes it")]
    docs = docs.unionByName(documents(spark, planted + ODD).select(docs.columns))
    found = find_secrets(docs).cache()
    got = {(r.doc_id, r.sha256) for r in found.collect()}
    pattern = re.compile(r'token = "([0-9a-f]{40})"')
    for r in docs.collect():
        for m in pattern.finditer(r.text or ""):
            assert (r.doc_id, hashlib.sha256(m.group(1).encode()).hexdigest()) in got
    assert 90_000 in {d for d, _ in got} and 90_001 not in {d for d, _ in got}
    clean = redact(docs, found)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert not [r for r in clean.collect() if pattern.search(r.text or "")]
    assert clean.where("doc_id = 90000").first().text == 'deploy with api_key = "[SECRET]" now'
    assert find_secrets(documents(spark, [])).count() == 0


def test_kneser_ney_sums_to_one(spark):
    docs = documents(spark, [(i, t) for i, t in enumerate(["abracadabra", "abba cabbage", "a cab", "bac"])])
    model = fit(docs)
    shard = _shard(model, 0)
    for context in ("abra", "zzzz", "cab "):
        keys, _ = ngram_keys([context])
        head = int(keys[-1]) << 12 & (1 << 60) - 1
        everything = head | np.arange(4096)
        assert abs(np.exp(log_probabilities(everything, shard, model.floor)).sum() - 1) < 1e-6


def test_kneser_ney_shards_agree(spark, data, monkeypatch):
    from dialogue_factors.llm import kneser_ney

    docs, labels = small(spark, data), small(spark, data, "labels")
    read = lambda: {r.doc_id: (round(r.perplexity, 6), r.keep) for r in classify(docs, labels).collect()}
    whole = read()
    monkeypatch.setattr(kneser_ney, "SHARD_ENTRIES", 20_000)
    assert read() == whole and len(whole) == docs.count()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    kept = lambda q: np.mean([keep for d, (_, keep) in whole.items() if quality.get(d) == q])
    assert kept(1) > 0.95 and kept(0) < 0.4
    odd = {r.doc_id: r for r in classify(documents(spark, ODD), labels.where("false")).collect()}
    assert odd[1000001].perplexity is None and not odd[1000001].keep and odd[1000008].keep
    assert classify(documents(spark, []), labels).count() == 0


def test_kneser_ney_shards_pass_the_driver_in_little(spark):
    """The driver holds a shard in some 35 bytes an entry of its Python, not in the 80 of a
    data frame and its groups, and a shard is a few megabytes whatever the model."""
    rows = 400_000
    entries = spark.range(rows).select(
        (F.col("id") % 8).cast("int").alias("model"), F.lit(4).alias("order"), (F.col("id") % 5 == 0).alias("context"),
        F.pmod(F.xxhash64("id"), F.lit(1 << 36)).alias("key"), (-F.col("id") / 7).alias("value"),
    )
    entries = entries.dropDuplicates(["model", "context", "key"])
    model = kneser_ney.Model(entries, 1, np.zeros(8), np.ones(8, bool))
    _shard(model, 0)
    tracemalloc.start()
    shard = _shard(model, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = {(bool(r.context), r.model << 60 | r.key): np.float32(r.value) for r in entries.collect()}
    got = {(c, k): v for (_, c), (keys, values) in shard.items() for k, v in zip(keys.view(np.uint64).tolist(), values)}
    assert set(shard) == {(4, False), (4, True)} and len(want) > 0.99 * rows
    assert got == {(c, k & (1 << 64) - 1): v for (c, k), v in want.items()}
    assert all((np.diff(keys) > 0).all() for keys, _ in shard.values())
    assert peak < 50 * rows
    assert peak / rows * kneser_ney.SHARD_ENTRIES < 25e6


def test_kneser_ney_pieces_hold_little(monkeypatch):
    """Texts judged in pieces give the bits of all texts at once, and a chunk of 2 MB holds
    some 40 bytes a symbol, not the 200 of running sums and words of the whole chunk."""
    draw = np.random.default_rng(6)
    words = ["".join(chr(97 + c) for c in draw.integers(0, 26, draw.integers(1, 12))) for _ in range(3000)]
    texts = [" ".join(words[w] for w in draw.integers(0, 3000, n)) for n in draw.integers(0, 900, 640)] + [""]
    fold = np.arange(len(texts)) % 2
    keys, offsets = ngram_keys(texts)
    seen = np.unique(keys)[::2]
    shard = {}
    for order in range(1, 6):
        some = np.unique(seen & (1 << 12 * order) - 1)
        some = np.concatenate([some | m << 60 for m in range(4)])
        shard[order, False] = some, -9 * draw.random(len(some)).astype(np.float32)
    shared = [SimpleNamespace(value=shard, _path=None)]
    run = lambda: kneser_ney.judge(texts, fold, shared, np.full(4, -9.0), 2)
    tracemalloc.start()
    got = run()
    assert tracemalloc.get_traced_memory()[1] < 80 * len(keys) and 1_700_000 < len(keys) < 2_300_000
    tracemalloc.stop()
    monkeypatch.setattr(kneser_ney, "PIECE", 1 << 40)
    for piece, whole in zip(got, run()):
        assert piece.tobytes() == whole.tobytes()
    values, second = (log_probabilities(keys, shard, np.full(4, -9.0), np.repeat(fold + m, np.diff(offsets))) for m in (0, 2))
    sums = np.concatenate([[0.0], np.cumsum(values)])
    assert np.array_equal(got[0], sums[offsets[1:]] - sums[offsets[:-1]])
    assert np.array_equal(got[3], worst_family(second - values, keys, offsets)) and got[3].max() > 0


def test_kneser_ney_counts_when_little_is_held(spark, monkeypatch):
    texts = [("abba cabbage", 0), (None, 1), ("a cab \u3042", 1), ("", 0), ("abba " * 40, 2), ("abba cabbage", 1), ("x", 2)]
    want = Counter()
    for text, part in texts:
        padded = [0] * 4 + [ord(c) if ord(c) < 3072 else 3072 + ord(c) % 1024 for c in text or ""]
        want.update((part, sum(c << 12 * (4 - j) for j, c in enumerate(padded[i:i + 5]))) for i in range(len(padded) - 4))
    docs = spark.createDataFrame(texts, "text string, part int").coalesce(1)
    for held in (10, 60, 4_000_000):
        monkeypatch.setattr(kneser_ney, "HELD_NGRAMS", held)
        monkeypatch.setattr(kneser_ney, "PIECE", 16)
        assert {(r.part, r.key): r.n for r in kneser_ney.count_ngrams(docs).collect()} == want


def test_kneser_ney_rare_languages(spark, data):
    docs, labels = small(spark, data), small(spark, data, "labels")
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    rows = sorted((r.doc_id, r.text, r.lang) for r in docs.where("lang in ('en', 'fr')").collect() if r.text)
    french = [r for r in rows if r[2] == "fr"]
    clean = [r for r in french if r[0] in good]
    seen = {r[0] for r in clean[:3]}
    few = docs.where(~F.col("doc_id").isin([r[0] for r in french]) | F.col("doc_id").isin([r[0] for r in clean]))
    trusted = labels.where(~F.col("doc_id").isin([r[0] for r in clean[3:]]))
    read = lambda lab: {r.doc_id: r for r in classify(few, lab).collect()}
    got = read(trusted)
    assert len(clean) > 4 and all(got[r[0]].keep for r in clean)
    assert len({round(r.threshold, 9) for r in got.values() if r.lang in ("en", "fr")}) == 2
    got = read(labels.where(~F.col("doc_id").isin([r[0] for r in clean])))
    assert all(got[r[0]].keep for r in clean) and not all(r.keep for r in got.values())


# Ten times as many labels as in these tables give the shares that the README reports.
LEAST_TOXIC = {"en": 0.95, "de": 0.7, "es": 0.5, "fr": 0.7}


def test_worst_family_against_loops():
    draw = random.Random(4)
    texts = [" ".join(draw.choice(["insulta", "insultb", "insulte.", "abcdefg", "x", "insult"]) for _ in range(draw.randint(0, 9))) + draw.choice(["", " "]) for _ in range(50)]
    keys, offsets = ngram_keys(texts)
    ratios = np.random.default_rng(4).normal(0.1, 0.4, len(keys))
    for t, low, got in zip(texts, offsets, worst_family(ratios, keys, offsets)):
        words = {}
        for m in re.finditer(r"\S+", t):
            said = min(ratios[low + m.start():low + min(m.end() + 1, len(t))].sum() - 0.5, 3.0)
            if said > 0 and m.end() - m.start() > 5:
                name = m.group().rstrip(".")
                words[name] = max(words.get(name, 0), said)
        families = Counter()
        for w, said in words.items():
            families[w[:5]] += said
        assert abs(got - max(families.values(), default=0)) < 1e-9


def test_kneser_ney_toxic(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in QUERIES["op8_kneser_ney_quality"](spark, folder).collect()}
    labels = small(spark, folder, "labels").collect()
    toxic = [rows[r.doc_id] for r in labels if r.quality == 1 and r.toxic == 1]
    clean = [rows[r.doc_id] for r in labels if r.quality == 1 and r.toxic == 0]
    poor = [rows[r.doc_id] for r in labels if r.quality == 0]
    rejected = lambda some: np.mean([not r.keep for r in some])
    assert rejected(toxic) > 0.9 and rejected(clean) < 0.03 and rejected(poor) > 0.8
    for lang in ("en", "de", "es", "fr"):  # each judged by models that did not see it
        assert rejected([r for r in toxic if r.lang == lang]) >= LEAST_TOXIC[lang], lang
    docs, labels = small(spark, data), small(spark, data, "labels")
    assert classify(docs, labels.where("toxic = 0")).where("toxic").count() == 0


def test_decontamination(spark, data):
    docs, benchmark = small(spark, data), small(spark, data, "benchmark")
    items = {r.item_id: r.text for r in benchmark.collect()}
    long = max(items.values(), key=len)
    edited = list(long.upper())
    for i in range(20, len(edited), 30):
        edited[i] = "#"
    planted = [(90_000, "before  " + "".join(edited) + "\n after"), (90_001, long[:60]), (90_002, None)]
    docs = docs.unionByName(documents(spark, planted + ODD).select(docs.columns))
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, benchmark).collect()}
    whole = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in (r.text or "")}
    assert whole <= got and {d for d, _ in got} - {d for d, _ in whole} == {90_000}
    assert find_leaks(documents(spark, []), benchmark).count() == 0
    assert find_leaks(docs, benchmark.where("false")).count() == 0


def test_decontamination_at_every_offset(spark, data):
    benchmark = small(spark, data, "benchmark")
    long = " ".join(max((r.text for r in benchmark.collect()), key=len).split())
    item = spark.createDataFrame([(1, long)], "item_id long, text string")
    for size in (100, 110, 120):
        planted = [(i, f"zq xj vk {long[i:i + size]} kv jx qz") for i in range(len(long) - size + 1)]
        docs = documents(spark, planted)
        assert {r.doc_id for r in find_leaks(docs, item).collect()} == {i for i, _ in planted}, size


def test_lookup_table(spark, data):
    names = [f"s{i}" for i in range(10)]
    table = fill_table(names, 10_007)
    counts = np.bincount(table)
    assert counts.min() >= 1000 and counts.max() <= 1001
    fewer = fill_table(names[:-1], 10_007)
    stayed = (table == fewer)[table != 9].mean()
    assert stayed > 0.85
    docs = documents(spark, texts(spark, data))
    rows = assign_shards(docs, names, slots=10_007).collect()
    digest = lambda d: int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16) % 10_007
    assert len(rows) == docs.count() and all(r.slot == digest(r.doc_id) and r.shard == names[table[r.slot]] for r in rows)
    assert moved_rows(docs, names, names[:-1], slots=10_007).where("shard_after = 's9'").count() == 0
    with pytest.raises(ValueError):
        fill_table(names, 100)


def test_pipeline(spark, data):
    docs = small(spark, data)
    columns = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, data).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "ngram_jaccard_join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in docs.collect()} == {c for _, _, c in brute_components(rows)}
        if name == "benchmark_decontamination":
            items = [r.text for r in small(spark, data, "benchmark").collect()]
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
            assert gone == {r.doc_id for r in before.collect() if any(t in r.text for t in items)}
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    assert {r.doc_id for r in corpus_pipeline.run(spark, data).collect()} == {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_query_runs(spark, data, name):
    rows = QUERIES[name](spark, data)
    assert len(set(rows.columns)) == len(rows.columns)
    # Few documents may hold no secret and no benchmark item.
    assert rows.count() or name in ("op6_secret_forest", "op9_qgram_decontamination")


def test_letters_and_marks_of_words_are_encoded_once(monkeypatch):
    from tokenizers import Tokenizer

    encoder, library = tokens.WordEncoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    seen, inner = [], encoder._lists
    monkeypatch.setattr(encoder, "_lists", lambda texts: seen.extend(texts) or inner(texts))
    texts = ["house house, house. house!? (house", "Tree, tree. it's its' \u0130. \u0130, \u0958. \u03a3\u03a3. ", None]
    flat, offsets = encoder.encode(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    words = " ".join(seen).split()
    assert words.count("house") == 1 and words.count("tree") == 1 and words.count(",") == 1
