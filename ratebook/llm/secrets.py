"""Secret scans: fixed patterns plus a token-efficiency test.

Patterns give the kinds assign, access and hex.  The token test adds the kind
token: runs of 12 or more of ``[A-Za-z0-9+/_=-]`` that need many tokens of a
tiktoken vocabulary, that is few characters a token, look random; natural words
and code names need few.  Runs under 20 characters need a stricter ratio, since
some short rare words need as many tokens as short random ones.  Excluded before
the test: runs of digits alone, digests (hexadecimal runs of the length of a known
digest), UUIDs, dates and hardware addresses, and identifiers whose parts (split at
``_ - / = +``) are each digits alone or letters that the vocabulary has as one token
or needs few tokens for.  A token run that overlaps a pattern span is dropped;
pattern spans always stay.

Defined cases: a null or empty text has no spans; offsets count code points of the
whole text; ties are ordered by start, then by kind; other columns are carried,
those named like a result column are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, free_name

# fixed values: the three patterns with the least length of what they find
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
KINDS = ("assign", "access", "hex", "token")
# fixed values: hexadecimal lengths of md5, sha1, sha224, sha256, sha384, sha512
DIGESTS = {32, 40, 56, 64, 96, 128}
#: characters of a run at least, of one that isn't short, and characters a token of a random one at most, if short and else
RUN_MIN, RUN_LONG, RATIO_SHORT, RATIO_MAX = 12, 20, 1.6, 2.0
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{RUN_MIN},}}")
#: a run of 24 or more hexadecimal digits is what HEX leaves after the length test
LONG_HEX = re.compile(rf"[0-9a-f]{{{HEX_MIN},}}")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}")
ADDRESS = re.compile(r"[0-9a-fA-F]{2}(-[0-9a-fA-F]{2}){5,7}")
SCHEMA = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("n_token", T.LongType()),
          ("base_sha256", T.StringType()), ("spans", T.StringType())]


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern matches that are long enough."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def random_like(run: str, n: int, encoding) -> bool:  # noqa: ANN001
    """Few characters a token, by the limit for a run of n characters."""
    return len(run) <= (RATIO_MAX if n >= RUN_LONG else RATIO_SHORT) * len(encoding.encode_ordinary(run))


def excluded(run: str, encoding) -> bool:  # noqa: ANN001
    """Digests, dates, addresses and identifiers, which the token test leaves alone."""
    if run.isdigit() or UUID.fullmatch(run) or DATE.fullmatch(run) or ADDRESS.fullmatch(run):
        return True
    if len(run) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return True
    parts = [p for p in re.split(r"[_\-/=+]", run) if p and not p.isdigit()]
    return all(p.isalpha() for p in parts) and all(len(encoding.encode_ordinary(p)) == 1 or not random_like(p, len(run), encoding) for p in parts)


def token_spans(text: str, encoding, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:  # noqa: ANN001
    """Spans of the token test that overlap none of `taken` (sorted): a run overlaps one if a span that starts before its end reaches beyond its start."""
    out, starts, reach = [], [s for s, _, _ in taken], list(accumulate((e for _, _, e in taken), max))
    for m in RUN.finditer(text):
        run, before = m[0], bisect_left(starts, m.end())
        if before and reach[before - 1] > m.start() or not random_like(run, len(run), encoding):
            continue
        if not excluded(run, encoding):
            out.append((m.start(), 3, m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The rows (without the text) with n_assign, n_access, n_hex, n_token, base_sha256 and spans."""
    names = [n for n, _ in SCHEMA]
    kept = [c for c in df.columns if c not in names and c != text]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, t) for n, t in SCHEMA)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path, pattern)
        for batch in batches:
            for part in chunks(batch, batch.num_columns - 1):
                cols: dict[str, list] = {n: [] for n in names}
                for t in part.column(part.num_columns - 1).to_pylist():
                    base = base_spans(t or "")
                    more = token_spans(t or "", enc, base)
                    for k, n in enumerate(names[:3]):
                        cols[n].append(sum(s[1] == k for s in base))
                    cols["n_token"].append(len(more))
                    cols["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                    cols["spans"].append(joined(sorted(base + more)))
                arrays = [part.column(i) for i in range(len(kept))]
                arrays += [pa.array(cols[n], pa.string() if t == T.StringType() else pa.int64()) for n, t in SCHEMA]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *names])

    return df.select(*kept, df[text].alias(free_name(df, "_text"))).mapInArrow(run, schema)
