"""Secrets in texts: fixed patterns, and strings that a public vocabulary cannot shorten.

Patterns find assigned values, access keys and long hex runs.  The token-efficiency test goes on from there: an unbroken run
of ``RUN`` or more characters of the base64 and URL alphabets is encoded with a byte-pair vocabulary.  Words and paths take
few tokens for their length; a random string has no frequent pairs and takes many.  A run of fewer than ``RATIO``
characters per token is reported, unless it is a known digest or an identifier:

* digests: hex of the length of a published hash (with or without a name such as ``sha256:``), and the strings in ``known``;
* identifiers: UUIDs, numbers, times and versions, and runs of words joined by case, ``_``, ``-``, ``/`` or ``.``;
* runs of one kind of character alone, or of fewer than ``DISTINCT`` different ones.

What a pattern has found already is no part of a run.

Scale: one map over the rows, no shuffle; the vocabulary file is read once per Python worker.  A linear pattern over the whole
batch picks the texts that can hold anything at all, only those are searched.  Runs are encoded in pieces of ``PIECE``
characters, so a run of millions costs its length, not its square; no text is cut short.

Defined results: a null or empty text has no spans; every row is scanned by itself, so repeated rows give equal rows; a null doc_id is
carried; spans are in code points, end exclusive; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from hourglass.llm.chunks import text_blocks

ASSIGN, ACCESS, HEX, RANDOM = KINDS = ("assign", "access", "hex", "random")
RUN = 20          # shortest run that is tested
RATIO = 2.0       # characters per token below which a run is random
DISTINCT = 10     # different characters of a random run
PIECE = 256       # characters encoded at once

#: The patterns of the base kinds (fixed values) and the least length of the match, or of its second group.
BASE = {
    ASSIGN: (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ACCESS: (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    HEX: (re.compile(r"[0-9a-f]{32,}"), 0, 32),        # the same as runs of any length, the short ones dropped
}
#: A text without any of these holds no span.
_CAN_HOLD = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|[A-Za-z0-9+/_=.-]{%d}" % RUN
_RUNS = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % RUN)

#: Hex lengths of published hashes (fixed values): MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
_DIGEST = re.compile(r"(?:(?:md5|sha\d*|sha-?\d+)[-_=]?)?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
_NAMED_DIGEST = re.compile(r"sha(?:256|384|512)-[A-Za-z0-9+/]{43,88}={0,2}")
_UUID = re.compile(r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})")
#: Words joined into one name; a word is three letters or more, at most four digits behind it.
_NAME = re.compile(r"[_./=+-]*(?:(?:[A-Z]?[a-z]{2,}|[A-Z]{2,})\d{0,4}[_./=+-]*)+")
_NUMBER = re.compile(r"[0-9T.:+_/-]*")


def _is_name(run: str) -> bool:
    """Words of three letters or more on average, joined by case or marks."""
    if not _NAME.fullmatch(run):
        return False
    words = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", run)
    return 4 * len(words) <= sum(map(len, words))


class Scanner:
    """Spans of one text after another."""

    def __init__(self, vocabulary: str, known: frozenset[str] = frozenset(), ratio: float = RATIO):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known, self.ratio = known, ratio

    def tokens(self, run: str) -> int:
        return sum(len(self.coder.encode_ordinary(run[i:i + PIECE])) for i in range(0, len(run), PIECE))

    def is_random(self, run: str) -> bool:
        run = run.strip("=.-_/+")
        kinds = bool(re.search("[a-z]", run)) + bool(re.search("[A-Z]", run)) + bool(re.search("[0-9]", run))
        if len(run) < RUN or kinds < 2 or len(set(run)) < DISTINCT or run in self.known:
            return False
        if any(p.fullmatch(run) for p in (_DIGEST, _NAMED_DIGEST, _UUID, _NUMBER)) or _is_name(run):
            return False
        return len(run) < self.ratio * self.tokens(run)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end) of the patterns' spans."""
        return sorted((m.start(), i, m.end()) for i, (pattern, group, least) in enumerate(BASE.values())
                      for m in pattern.finditer(text) if len(m[group]) >= least)

    def spans(self, text: str) -> tuple[list, list]:
        """The patterns' spans, and all spans with those of the token-efficiency test."""
        base, rest, at = self.base(text), [], 0
        for start, _, end in base:                                      # found spans become spaces: offsets stay
            rest += [text[at:max(at, start)], " " * (end - max(at, start))]
            at = max(at, end)
        more = [(m.start(), len(BASE), m.end()) for m in _RUNS.finditer("".join([*rest, text[at:]])) if self.is_random(m[0])]
        return base, sorted(base + more)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_SCANNERS: dict[tuple, Scanner] = {}
_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def scan(docs: DataFrame, vocabulary: str, known: frozenset[str] = frozenset(), ratio: float = RATIO, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per document: spans of each kind, ``spans`` in order, and a digest of the patterns' spans."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def find(batches):
        key = (vocabulary, known, ratio)
        if key not in _SCANNERS:
            _SCANNERS[key] = Scanner(*key)
        scanner = _SCANNERS[key]
        for batch in batches:
            for part in text_blocks(batch):
                texts = part.column("text")
                may = pc.fill_null(pc.match_substring_regex(texts, _CAN_HOLD), False).to_numpy(zero_copy_only=False)
                none = ([0] * 4, hashlib.sha256(b"").hexdigest(), "")
                out = [none] * part.num_rows
                for i in may.nonzero()[0].tolist():
                    base, every = scanner.spans(texts[i].as_py())
                    counts = [sum(s[1] == k for s in every) for k in range(len(KINDS))]
                    out[i] = counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)
                counts = [pa.array([o[0][k] for o in out], pa.int64()) for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array([o[1] for o in out], pa.string()),
                                                  pa.array([o[2] for o in out], pa.string())],
                                                 names=[c.split()[0] for c in _SCHEMA.split(", ")])

    return rows.mapInArrow(find, _SCHEMA)


def redacted(docs: DataFrame, vocabulary: str, mark: str = "[secret]", text_col: str = "text", known: frozenset[str] = frozenset(),
             ratio: float = RATIO) -> DataFrame:
    """``docs`` with every span of every text replaced by ``mark`` (spans that overlap are one); other columns are carried."""

    def clean(texts):
        import pandas as pd

        key = (vocabulary, known, ratio)
        if key not in _SCANNERS:
            _SCANNERS[key] = Scanner(*key)

        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for start, _, end in _SCANNERS[key].spans(text)[1]:
                if start >= at:
                    out += [text[at:start], mark]
                at = max(at, end)
            return "".join([*out, text[at:]])

        for t in texts:
            yield pd.Series([one(x) for x in t], dtype=object)

    from collections.abc import Iterator

    import pandas as pd

    clean.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(text_col, F.pandas_udf(clean, "string")(F.col(f"`{text_col}`")))
