"""Secret scan: a random forest removes false positives from candidate findings."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from dialogue_factors.llm.common import NO_ID, batch, bounded, chunks, keyed, utf8
from dialogue_factors.llm.tokens import default_tokenizer
from dialogue_factors.session import materialize

# Words next to a value that speak for or against a secret.
KEY_WORDS = ("secret", "token", "pass", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private")
HARMLESS_WORDS = ("example", "sample", "dummy", "placeholder", "fake", "test", "commit", "revision", "checksum", "sha1", "sha256", "md5", "digest", "uuid", "id", "version", "order", "card", "phone", "call", "account", "isbn", "image")
FEATURES = (
    "length", "entropy", "digits", "upper", "lower", "symbols", "class_changes", "transitions",
    "dictionary", "in_path", "path_hint", "key_word", "harmless_word", "assigned", "quoted", "distinct", "login",
)
# A private-key header; the password of a URL; a value after = or :, up to the next blank or
# quote and without closing marks, unless a further assignment or a URL begins there;
# a run of key characters.
CANDIDATE = re.compile(
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"|://[^\s/:@\"']*:(?P<login>[^\s@\"']{3,})@"
    r"|[=:]\s?[\"']?(?!//|[A-Za-z_][\w.+\-]*(?:=[^\s=\"']|://))(?P<value>[^\s\"'<>]{7,}[^\s\"'<>.,;:)\]}])"
    r"|(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=\-]))?"
)
PRINTABLE = 96
# Rows of labelled findings that the forest is fitted on, at most.
TRAINING_ROWS = 20_000
FOUND = "doc_id long, key_id long, key_text long, start long, length long, sha256 string, features array<double>"


def transition_logs(docs: DataFrame) -> np.ndarray:
    """Log-probability of each printable character after another, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PRINTABLE * PRINTABLE, np.int64)
        for rows in batches:
            data, offsets = utf8(rows.column(0))
            for low, high in chunks(offsets):
                kinds = _printable(data[offsets[low]:offsets[high]])
                if len(kinds) > 1:
                    total += np.bincount(kinds[:-1] * PRINTABLE + kinds[1:], minlength=len(total))
        seen = np.flatnonzero(total)
        yield batch(pair=pa.array(seen.astype(np.int32)), n=pa.array(total[seen]))

    pairs = docs.select("text").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    counts = np.full(PRINTABLE * PRINTABLE, 1.0)
    counts[pairs.pair.to_numpy(int)] += pairs.n.to_numpy(float)
    counts = counts.reshape(PRINTABLE, PRINTABLE)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _printable(data: np.ndarray) -> np.ndarray:
    return np.where((data > 32) & (data < 127), data, 32).astype(np.int64) - 32


def dictionary_words(tokenizer: str | None = None, shortest: int = 4) -> frozenset[str]:
    """Whole words of a public tokenizer's vocabulary."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer or default_tokenizer()).get_vocab()
    words = (t.removesuffix("</w>") for t in vocabulary if t.endswith("</w>"))
    return frozenset(w for w in words if len(w) >= shortest and w.isascii() and w.isalpha())


def candidate_spans(text: str) -> Iterator[tuple[int, int]]:
    """Places of all candidates of a text, for scanning and for training alike."""
    for m in CANDIDATE.finditer(text):
        yield m.span(m.lastgroup or 0)


def _coverage(text: str, words: frozenset[str]) -> float:
    lowered, covered, i = text.lower(), 0, 0
    while i < len(lowered):
        size = next((n for n in range(min(14, len(lowered) - i), 3, -1) if lowered[i:i + n] in words), 0)
        covered, i = covered + size, i + max(size, 1)
    return covered / max(len(lowered), 1)


def features(text: str, start: int, end: int, path: str, logs: np.ndarray, words: frozenset[str]) -> list[float]:
    value, before, after = text[start:end], text[max(0, start - 80):start], text[end:end + 60]
    n = len(value)
    counts = np.array([value.count(c) for c in set(value)], float)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    codes = _printable(np.frombuffer(value.encode("utf-8", "surrogatepass"), np.uint8))
    share = lambda k: kinds.count(k) / n
    near = re.findall(r"[a-z0-9_\-]+", before.lower())[-5:] + re.findall(r"[a-z0-9_\-]+", after.lower())[:3]
    last = before.rstrip("\"' ")[-1:]
    return [
        float(n), float(-(counts / n * np.log2(counts / n)).sum()), share("d"), share("u"), share("l"), share("s"),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        float(logs[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0,
        _coverage(value, words), float("://" in before.split(" ")[-1] or before[-1:] in ("/", "\\") or value.count("/") > 2),
        float(any(w in path.lower() for w in ("test", "example", "sample", "fixture", "mock"))),
        float(any(k in w for k in KEY_WORDS for w in near)), float(any(w in HARMLESS_WORDS for w in near)),
        float(last in ("=", ":")), float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')), len(counts) / n,
        float(after[:1] == "@" and "://" in before.split(" ")[-1]),
    ]


def find_candidates(docs: DataFrame, logs: np.ndarray, words: frozenset[str], path: str | None = "source") -> DataFrame:
    """`doc_id, key_id, key_text, start, length, sha256, features` of every candidate, in
    whole texts. The value itself is not passed on, only its digest."""
    source = F.col(path).cast("string") if path and path in docs.columns else F.lit("")
    rows = keyed(docs.withColumn("__path", F.coalesce(source, F.lit(""))), "__path")
    model = docs.sparkSession.sparkContext.broadcast((logs, words))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, words = model.value
        for rows in batches:
            _, sizes = utf8(rows.column(3))
            for low, high in chunks(sizes):
                part = rows.slice(low, high - low)
                at, found = [], []
                for i, (text, place) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist())):
                    for begin, end in candidate_spans(text):
                        at.append(i)
                        digest = hashlib.sha256(text[begin:end].encode("utf-8", "surrogatepass")).hexdigest()
                        found.append((begin, end - begin, digest, features(text, begin, end, place, logs, words)))
                if found:
                    ids = part.take(pa.array(at))
                    start, length, digest, values = zip(*found)
                    yield batch(
                        doc_id=ids.column(0), key_id=ids.column(1), key_text=ids.column(2), start=pa.array(start, pa.int64()),
                        length=pa.array(length, pa.int64()), sha256=pa.array(digest), features=pa.array(values, pa.list_(pa.float64())),
                    )

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "key_id", "key_text", "text", "__path").mapInArrow(scan, FOUND)


def _password(draw: random.Random, words: list[str]) -> str:
    """What people choose: a word in odd spelling with digits and marks."""
    word = draw.choice(words)
    word = "".join({"a": "4", "e": "3", "i": "1", "o": "0", "s": "5"}.get(c, c) if draw.random() < 0.5 else draw.choice((c, c.upper())) for c in word)
    return word + draw.choice("!@#$%&*") + draw.choice((str(draw.randint(1, 9999)), draw.choice(words).title(), draw.choice("abcXYZ") + str(draw.randint(10, 99))))


def _secret(draw: random.Random, words: list[str]) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    make = lambda n, alphabet: "".join(draw.choice(alphabet) for _ in range(n))
    name = draw.choice(("token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret", "db_pass", "pgpassword", "passwd", "aws_secret", "private_token"))
    name = draw.choice((name, name.upper(), f"{draw.choice(words)}_{name}".upper()))
    value = draw.choice((
        make(40, "0123456789abcdef"), make(32, "0123456789abcdef"), make(64, "0123456789abcdef"), "AKIA" + make(16, letters[:26] + "234567"),
        "AKIA" + make(16, letters[:26] + letters[52:]), make(40, letters + "+/"), make(40, letters[:52] + "+/"), "ghp_" + make(36, letters), "sk_live_" + make(24, letters),
        make(draw.randint(10, 20), letters + "!@#$%^&*"), "eyJ" + make(60, letters + "_-"), _password(draw, words), _password(draw, words),
    ))
    if draw.random() < 0.15:
        login = draw.choice(words) + ":\0" + value.replace("@", "!").replace("/", "x") + "\0"
        return f"{draw.choice(('postgres', 'mysql', 'https', 'amqp'))}://{login}@{draw.choice(words)}.internal/{draw.choice(words)}"
    if value.startswith(("AKIA", "ghp_", "sk_live_", "eyJ")) and draw.random() < 0.6:
        return "\0" + value + "\0"  # kinds of keys that also stand alone
    form = draw.choice(('{} = "{}"', "{}={}", "{}={}", "export {}={}", "{}: {}", '"{}": "{}"', "{} = '{}'"))
    return form.format(name, "\0" + value + "\0")


def _decoy(draw: random.Random, words: list[str]) -> str:
    make = lambda n, alphabet="0123456789abcdef": "".join(draw.choice(alphabet) for _ in range(n))
    word = lambda: draw.choice(words)
    uuid = "-".join(make(n) for n in (8, 4, 4, 4, 12))
    return draw.choice((
        f"commit \0{make(40)}\0", f"sha256 \0{make(64)}\0", f"checksum: \0{make(32)}\0", f"uuid \0{uuid}\0", f"id = \0{uuid}\0",
        f"https://{word()}.example.com/\0{word()}/{word()}-{make(6)}/{word()}{make(2, '0123456789')}\0",
        f"/usr/\0{word()}/{word()}/{word()}-{make(2, '0123456789')}.{make(1, '0123456789')}\0", f"password = \0{'x' * draw.randint(8, 20)}\0",
        f"token = \"\0YOUR_{word().upper()}_TOKEN_{make(2, '0123456789')}\0\"", f"api_key: \0{word()}_{word()}_{word()}_1\0",
        f"card \0{make(16, '0123456789')}\0", f"call \0{make(3, '0123456789')}-{make(3, '0123456789')}-{make(4, '0123456789')}-{make(4, '0123456789')}\0",
        f"note: \0{word()}{word()}{word()}\0", f"{word()}: \0{word()}{word()}\0", f"{word()} \0{word()}-{word()}-{word()}-{draw.randint(1, 99)}\0",
        f"{word().upper()}_DIR=\0/{word()}/{word()}/{word()}\0", f"{word()}={word()}&{word()}=\0{word()}{word()}\0", f"{word()} \0{word()}{word()}{word()}{word()}\0",
        f"{word()}: \0{word()}/{word()}\0", f"at: \0{make(4, '0123456789')}-{make(2, '0123456789')}-{make(2, '0123456789')}T{make(2, '0123456789')}\0",
        f"{word().upper()} \0{word().upper()}{word().upper()}{word().upper()}{word().upper()}\0!!", f"\0{make(draw.randint(16, 24), 'AEIOULMNRSTCHDGP')}\0",
        f"{word()} \0{make(draw.randint(16, 24), 'aeioulmnrstchdgp')}\0", f"{word()}. \0{make(draw.randint(16, 24), 'aeioulmnrstchdgp').title()}\0", f"https://{word()}:\0{make(4, '0123456789')}/{word()}/{word()}\0", f"order \0{make(20, '0123456789')}\0", f"secret = \0{word()}{word()}\0", f"image \0{word()}_{make(8, '0123456789')}_{word()}\0",
    ))


def labelled_findings(docs: DataFrame, logs: np.ndarray, words: frozenset[str], documents: int = 2000) -> DataFrame:
    """`label, features`: secrets and look-alikes set into real text.

    A sample of `documents` texts, by hash of id and text, lends its words as neighbours;
    each gets three made secrets (label 1) and six look-alikes (label 0), drawn from its
    id. The ids are chosen first, and only their texts are shuffled.
    """
    known = docs.where("text is not null and doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text"
    )
    ids = known.select("doc_id", "key").distinct().orderBy(F.xxhash64("doc_id", "key"), "doc_id", "key").limit(documents)
    ids = materialize(ids, "sample")
    chosen = known.join(F.broadcast(ids), ["doc_id", "key"], "left_semi").groupBy("doc_id", "key").agg(F.first("text").alias("text"))
    chosen = chosen.repartition("doc_id").select("doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast((logs, words))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, words = model.value
        plain = sorted(words)
        for rows in batches:
            labels, values = [], []
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                draw = random.Random(doc_id)
                # the text is only context: what it may hold itself is not labelled
                own = [w for w in text.split() if w.isalpha()] or ["text"]
                for j in range(9):
                    label = int(j < 3)
                    made = _secret(draw, plain) if label else _decoy(draw, plain)
                    left, right = (" ".join(draw.choice(own) for _ in range(draw.randint(0, 12))) for _ in range(2))
                    joint = draw.choice((" ", " ", "\n", "### ", ". "))
                    around = f"{left}{joint}{made}{joint[::-1]}{right}"
                    start = around.index("\0")
                    end = around.index("\0", start + 1) - 1
                    around = around.replace("\0", "")
                    for a, b in candidate_spans(around):  # as a scan would cut it
                        if a < end and b > start:
                            labels.append(label)
                            values.append(features(around, a, b, "", logs, words))
                            break
            yield batch(label=pa.array(labels, pa.int32()), features=pa.array(values, pa.list_(pa.float64())))

    return chosen.mapInArrow(make, "label int, features array<double>")


def fit_forest(findings: DataFrame, trees: int = 40, depth: int = 8) -> RandomForestClassificationModel:
    """A random forest from `label, features` rows, `TRAINING_ROWS` of them at most."""
    rows = findings.limit(TRAINING_ROWS).select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("vector"))
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=7)
    return forest.fit(rows)


def judge(candidates: DataFrame, forest: RandomForestClassificationModel, threshold: float = 0.5) -> DataFrame:
    """Candidates that the forest takes for secrets, with their probability."""
    judged = forest.transform(candidates.withColumn("vector", array_to_vector("features")))
    sure = judged.withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return sure.where(F.col("probability") >= threshold).drop("vector", "rawPrediction", "prediction")


def find_secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, path: str | None = "source") -> DataFrame:
    """Secrets in all documents: `doc_id, key_id, key_text, start, length, sha256,
    features, probability`, places in code points.

    Candidates are values of 8 or more characters after = or :, passwords in URLs, runs of
    16 or more key characters, and private-key headers; whole texts are searched, however
    long, and the decision is the forest's. `findings` (`label, features`) are labelled findings;
    without them `labelled_findings` makes some. Null and empty texts have none; repeated
    rows have theirs each; other columns are not read, but for `path`.
    """
    logs, words = transition_logs(docs), dictionary_words()
    labelled = findings if findings is not None else materialize(labelled_findings(docs, logs, words), "findings")
    if labelled.select("label").distinct().count() < 2:
        return docs.sparkSession.createDataFrame([], FOUND + ", probability double")
    return judge(find_candidates(docs, logs, words, path), fit_forest(labelled), threshold)


def redact(docs: DataFrame, secrets: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with each found stretch of `text` replaced, and `n_chars` (if any) counted
    anew in those rows. All columns and rows stay."""
    spans = secrets.groupBy("key_id", "key_text").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("__spans"))
    spans = materialize(spans.select(F.col("key_id").alias("__id"), F.col("key_text").alias("__text"), "__spans"), "spans")
    joined = docs.withColumn("__i", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("__t", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = joined.join(bounded(spans, 200), (F.col("__i") == F.col("__id")) & (F.col("__t") == F.col("__text")), "left")
    cleaned = F.expr(f"""
        aggregate(__spans, named_struct('out', '', 'at', 0L),
            (acc, s) -> named_struct('out', concat(acc.out, substring(text, int(acc.at) + 1, int(s.start - acc.at)), '{mark}'), 'at', s.start + s.length),
            acc -> concat(acc.out, substring(text, int(acc.at) + 1)))
    """)
    out = joined.withColumn("text", F.when(F.col("__spans").isNotNull(), cleaned).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        counted = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNotNull(), counted).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
