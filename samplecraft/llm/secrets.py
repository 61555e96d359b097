"""Secret scan with a random forest that removes false positives.

Rules find candidates (known key shapes, long runs with digits, values given to
names that contain a secret-like word, as ``db_password``).  Each has features of its length, character transitions,
dictionary coverage, path and neighbouring words.  A random forest, trained on
labelled findings, gives the probability that it is a secret.

The labelled findings are made by rule (``labelled_findings``): keys, tokens and
passwords on one side; checksums, commit ids, UUIDs, numbers, slugs and
placeholders on the other, each among the words that go with it.  Their number
is a parameter.  The dictionary is a public tokenizer's whole-word entries,
read from a path.

Nulls: a null text has no candidates; a null id or path is kept as null, a null
path has no path words.  Whole texts are scanned, however long; repeated rows
are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .text import sub_batches

TRAIN_FINDINGS = 4000
THRESHOLD = 0.5
TREES, DEPTH = 60, 10
_RUN = "A-Za-z0-9+/_=.~-"
#: an identifier with a secret-like word in it; atomic, as any such word in it does
_NAME = r"(?<![\w.-])(?>[\w.-]*?(?i:password|passwd|pwd|passphrase|secret|token|api_?key))[\w.-]*+[\"']?\s*[:=]\s*"
#: an open value is not itself such a name with a value (``secrets: db_password="..."``)
_NAMED = re.compile(
    r"(?P<pem>-----BEGIN [A-Z ]*PRIVATE KEY-----)"
    rf"|{_NAME}(?:[\"']|(?!{_NAME}[\"']?[^\s\"'<>]{{6}}))(?P<given>[^\s\"'<>]{{6,}})")
_RUNS = re.compile(rf"(?<![{_RUN}])(?=[A-Za-z+/_=.~-]*+[0-9])(?P<run>[{_RUN}]{{12,}})")
_SHAPES = re.compile(r"(?i:AKIA)[0-9A-Za-z]{16}$|gh[pousr]_\w{30,}|xox[baprs]-|AIza[\w-]{30,}|sk[-_]\w{16,}|eyJ[\w-]+\.|-----BEGIN")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_NEAR_YES = frozenset("token secret password passwd pwd passphrase key apikey api auth authorization bearer credential "
                      "credentials private access aws login".split())
_NEAR_NO = frozenset("sha sha1 sha256 md5 checksum digest hash commit revision etag uuid guid id version isbn issn phone tel "
                     "call order invoice tracking card account serial build image".split())
_FAKE = frozenset("example sample dummy fake test placeholder your changeme xxx redacted none null todo".split())
_PATH_TEST = re.compile(r"test|example|sample|mock|fixture|doc|readme|spec", re.I)
_PATH_CODE = re.compile(r"\.(env|ya?ml|json|ini|cfg|conf|toml|properties|py|js|ts|go|java|rb|sh|tf)$", re.I)
_PATH_LOCK = re.compile(r"lock|sum$|\.min\.|checksums?|manifest", re.I)
_LETTERS = re.compile(r"[a-z]+")
FEATURES = ["length", "digits", "uppers", "marks", "class_turns", "repeats", "entropy", "hex_only", "number_only", "uuid",
            "known_shape", "dictionary", "vowel_turns", "given", "quoted", "assigned", "near_yes", "near_no", "near_fake",
            "own_fake", "path_test", "path_code", "path_lock"]


@functools.lru_cache(maxsize=2)
def dictionary(path: str) -> frozenset[str]:
    """Whole words of four or more letters in a tokenizer file's vocabulary."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return frozenset(w for w in (t.removesuffix("</w>") for t in vocab if t.endswith("</w>")) if len(w) >= 4 and w.isalpha())


def _matches(text: str) -> Iterator[re.Match]:
    at = 0
    for m in _NAMED.finditer(text):
        yield from _RUNS.finditer(text, at, m.start())
        yield m
        at = m.end()
    yield from _RUNS.finditer(text, at)


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, rule) of every candidate in a text, in order; runs are looked for between the named ones."""
    for m in _matches(text):
        rule = m.lastgroup
        start, end = m.span(rule)
        if rule != "pem":
            while end > start and text[end - 1] in ".,;:!?)=-" and (rule == "given" or text[end - 1] in ".-"):
                end -= 1
            while start < end and text[start] in ".-=" and rule == "run":
                start += 1
        if end - start >= 6:
            yield start, end, rule


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(text: str, start: int, end: int, rule: str, path: str | None, words: frozenset[str]) -> list[float]:
    """The features of one candidate, in the order of ``FEATURES``."""
    s = text[start:end]
    n = len(s)
    kinds = [_class(c) for c in s]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1)
    counts = Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    low = s.lower()
    covered = sum(_covered(w, words) for w in _LETTERS.findall(low)) / n
    letters = [c for c in low if c.isalpha()]
    vowel = [c in "aeiou" for c in letters]
    before = text[max(0, start - 48):start].lower()
    near = set(_LETTERS.findall(before)) | set(_LETTERS.findall(text[end:end + 24].lower()))
    own = set(_LETTERS.findall(low))
    p = path or ""
    flags = [
        all(c in "0123456789abcdefABCDEF" for c in s), all(k in (0, 3) for k in kinds), bool(_UUID.match(s)),
        bool(_SHAPES.match(s))]
    flags2 = [rule == "given", before[-1:] in "\"'" and before != "", bool(re.search(r"[:=]\s*[\"']?$", before)),
              bool(near & _NEAR_YES), bool(near & _NEAR_NO), bool(near & _FAKE), bool(own & _FAKE),
              bool(_PATH_TEST.search(p)), bool(_PATH_CODE.search(p)), bool(_PATH_LOCK.search(p))]
    return [float(min(n, 256)), kinds.count(0) / n, kinds.count(2) / n, kinds.count(3) / n, turns,
            max(counts.values()) / n, entropy, *map(float, flags), covered,
            sum(a != b for a, b in zip(vowel, vowel[1:])) / max(1, len(vowel) - 1), *map(float, flags2)]


def _covered(run: str, words: frozenset[str]) -> int:
    """Letters of a run inside dictionary words, the longest word first at each place."""
    at = total = 0
    while at < len(run):
        for k in range(min(16, len(run) - at), 3, -1):
            if run[at:at + k] in words:
                total += k
                at += k
                break
        else:
            at += 1
    return total


def labelled_findings(words: frozenset[str], n: int = TRAIN_FINDINGS, seed: int = 0) -> list[tuple[list[float], float]]:
    """(features, 1 for a secret) of ``n`` findings made by rule."""
    r = random.Random(seed)
    vocab = sorted(words)
    out: list[tuple[list[float], float]] = []

    def pick(chars: str, lo: int, hi: int) -> str:
        return "".join(r.choice(chars) for _ in range(r.randint(lo, hi)))

    hexs, digits = "0123456789abcdef", "0123456789"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alnum = upper + upper.lower() + digits

    def word() -> str:
        return r.choice(vocab)

    def phrase(k: int) -> str:
        return " ".join(word() for _ in range(k))

    def given(value: str) -> str:
        name = r.choice(("token", "secret", "api_key", "password", "apikey", "auth_token", "aws_secret_access_key", "client_secret"))
        return f"{name}{r.choice((' = ', '=', ': ', ' := '))}{r.choice(('', chr(34), chr(39)))}{value}"

    yes = [lambda: given(pick(hexs, 24, 64)), lambda: given(pick(alnum, 16, 64)), lambda: given(pick(alnum + "+/", 30, 60) + "=="),
           lambda: given(pick(alnum + "!@#%", 10, 20)), lambda: f"{phrase(3)} AKIA{pick(upper + digits, 16, 16)} {phrase(2)}",
           lambda: f"key AKIA{pick(upper + digits, 16, 16)}", lambda: f"{phrase(2)} ghp_{pick(alnum, 36, 36)}",
           lambda: f"bearer {pick(alnum + '_-', 30, 60)}", lambda: f"{phrase(1)} sk-{pick(alnum, 30, 48)}",
           lambda: f"eyJ{pick(alnum, 20, 30)}.eyJ{pick(alnum, 30, 60)}.{pick(alnum, 30, 43)}",
           lambda: f"xoxb-{pick(digits, 10, 12)}-{pick(alnum, 24, 24)}", lambda: "-----BEGIN RSA PRIVATE KEY-----",
           lambda: given(pick(hexs, 26, 40)).upper(), lambda: f"{phrase(2)} api key {pick(alnum, 32, 40)} {phrase(1)}"]
    no = [lambda: f"{phrase(2)} commit {pick(hexs, 40, 40)}", lambda: f"sha256: {pick(hexs, 64, 64)}", lambda: f"md5 {pick(hexs, 32, 32)}",
          lambda: f"id {pick(hexs, 8, 8)}-{pick(hexs, 4, 4)}-{pick(hexs, 4, 4)}-{pick(hexs, 4, 4)}-{pick(hexs, 12, 12)}",
          lambda: f"{phrase(3)} {pick(digits, 12, 19)} {phrase(2)}", lambda: f"call {pick(digits, 3, 3)}-{pick(digits, 3, 3)}-{pick(digits, 4, 4)}",
          lambda: f"{phrase(2)} {word()}-{word()}-{word()}-{pick(digits, 1, 4)} {phrase(1)}",
          lambda: f"/{word()}/{word()}/{pick(digits, 2, 6)}.html", lambda: f"{word()}.{pick(digits, 2, 2)}@{word()}.com",
          lambda: given(r.choice(("your_api_key_123", "changeme123", "xxxxxxxxxxxx1234", "example_token_1", "placeholder", "${TOKEN}", "redacted",
                                  "os.environ[TOKEN]", "test_secret_1", "dummy123456", "none1234"))),
          lambda: given(f"{word()}_{word()}"), lambda: f"example token {pick(alnum, 20, 30)}",
          lambda: f"version {pick(digits, 1, 2)}.{pick(digits, 1, 2)}.{pick(digits, 1, 3)}-{word()}.{pick(digits, 8, 8)}",
          lambda: f"{phrase(2)} {word()}{word()}{pick(digits, 1, 4)} {phrase(1)}", lambda: f"{'=' * 12}{pick(digits, 1, 2)}{'=' * 12}",
          lambda: f"data:image/png;base64,{pick(alnum + '+/', 80, 200)}", lambda: f"order {pick(upper, 2, 3)}{pick(digits, 10, 14)}"]
    paths = ["src0", "src7", "config/prod.env", "deploy/app.yaml", "src/main.py", "web", None]
    soft = ["tests/test_auth.py", "docs/readme.md", "package-lock.json", "go.sum", "examples/config.yaml"]
    while len(out) < n:
        label = float(r.random() < 0.5)
        text = r.choice(yes if label else no)()
        path = r.choice(paths if label or r.random() < 0.6 else soft)
        text = f"{phrase(r.randint(0, 4))} {text}{r.choice(('', '.', chr(34), ' ' + phrase(2)))}"
        for start, end, rule in candidates(text):
            if len(out) < n:
                out.append((features(text, start, end, rule, path, words), label))
    return out


@functools.lru_cache(maxsize=4)
def _training_rows(dictionary_path: str, n: int, seed: int) -> tuple:
    return tuple((x, y) for x, y in labelled_findings(dictionary(dictionary_path), n, seed))


def train(spark: SparkSession, dictionary_path: str, n: int = TRAIN_FINDINGS, seed: int = 0):
    """The forest, trained on ``n`` labelled findings (one partition: the same trees on every cluster)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    rows = [(x, y) for x, y in _training_rows(dictionary_path, n, seed)]
    df = spark.createDataFrame(rows, "x array<double>, label double").coalesce(1)
    df = df.select(array_to_vector("x").alias("features"), "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, subsamplingRate=0.8).fit(df)


def scan(docs: DataFrame, dictionary_path: str, id_col: str = "doc_id", text_col: str = "text",
         path_col: str | None = "source") -> DataFrame:
    """(doc_id, start, length, rule, secret_sha256, x) of every candidate; one Arrow pass, no shuffle."""
    import hashlib
    ship_package(docs.sparkSession)
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    src = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("start", T.IntegerType()),
                           T.StructField("length", T.IntegerType()), T.StructField("rule", T.StringType()),
                           T.StructField("secret_sha256", T.StringType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        words = None
        for whole in batches:
            for b in sub_batches(whole, "text"):
                row, cols = [], ([], [], [], [], [])
                for k, (p, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                    for start, end, rule in candidates(text or ""):
                        words = words or dictionary(dictionary_path)
                        row.append(k)
                        digest = hashlib.sha256(text[start:end].encode()).hexdigest()
                        for c, v in zip(cols, (start, end - start, rule, digest, features(text, start, end, rule, p, words))):
                            c.append(v)
                if row:
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(row)), *[pa.array(c, t) for c, t in zip(cols, (
                            pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64())))]], names=schema.names)

    return src.filter("text <> ''").mapInArrow(run, schema)


def judge(found: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """Candidates with their probability and whether they are findings."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    scored = model.transform(found.withColumn("features", array_to_vector("x")))
    p = vector_to_array("probability")[1]
    return scored.select("doc_id", "start", "length", "rule", "secret_sha256", p.alias("score"),
                         (p >= threshold).alias("finding"))


def find_secrets(docs: DataFrame, dictionary_path: str, id_col: str = "doc_id", text_col: str = "text",
                 path_col: str | None = "source", findings: int = TRAIN_FINDINGS) -> DataFrame:
    """Every candidate of every text, judged."""
    return judge(scan(docs, dictionary_path, id_col, text_col, path_col),
                 train(docs.sparkSession, dictionary_path, findings))


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """A text with the given (start, length) spans replaced."""
    out, at = [], 0
    for start, length in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
            at = start + length
    return "".join([*out, text[at:]])
