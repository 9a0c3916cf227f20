r"""Secret scans: three fixed patterns, and a battery of randomness tests.

The patterns give the base spans. Beyond them, every unbroken run of 20 or more
characters of `[A-Za-z0-9+/_=-]` is cut at each "=" that is not its padding, as
in NAME=value. A part that no base span touches is a candidate. Where no
alphabet holds a part, as in a path with both "/" and "-", the longest pieces of
it that base 62, base 64 or its form for addresses hold are candidates instead;
those that are reported and overlap make one span. A candidate's encoding is inferred from the characters it uses (hexadecimal, base 32, base 36,
base 62, base 64), and three tests ask whether it looks drawn at random from
that alphabet:

* chi-squared: characters, in classes of equal expected count, are uniform;
* runs: the number of runs above and below the alphabet's middle is that of an
  independent sequence (Wald and Wolfowitz);
* serial correlation: neighbouring symbols are uncorrelated.

The three p-values are combined (Fisher). A candidate is reported if it looks random
enough, is long enough for its alphabet to tell random from ordinary text (`LEAST`)
and mixes two of digits, lower and upper case. How random is enough is set for each
stratum of encoding and length, since a short run gives the tests less power:

* at least so much that a random run of the stratum is given up with chance `miss`;
* and so much that of the runs reported, a share of `alpha` at most is ordinary. What
  random runs of the stratum score is known, from runs drawn at random; so the
  candidates in their upper half tell how many random ones there are, and what stands
  above a cut beyond their number is ordinary. The cut rises until that is no more
  than the share allowed and two standard deviations of the count, which is what
  chance may add in a stratum of few candidates.

P-values enter this control through a histogram of fixed size for each stratum, so
the driver gets a bounded table whatever the corpus holds.

Null and empty texts have no spans, very long ones are read whole, an empty table
gives none. Every row gives one row, repeated ids and texts too. Offsets are code
points, ends exclusive. No other column of the input is read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("upper_hex", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36_upper", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64_url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_PLACE = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS}
#: Shortest run of each encoding for which the tests have power.
LEAST = {"hex": 32, "upper_hex": 24, "base32": 26, "base36": 24, "base36_upper": 24, "base62": 22, "base64": 22, "base64_url": 22}
BINS = 400
TOP = 40.0  # -log10 of the smallest p-value told apart


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi2_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees of freedom > x), by the incomplete gamma function's series or fraction."""
    if x <= 0:
        return 1.0
    a, x = k / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-14:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return min(1.0, front * h)


def infer_encoding(run: str) -> str | None:
    """The smallest alphabet that holds the run without its padding."""
    used = set(run.rstrip("="))
    return next((name for name, letters in ALPHABETS if used <= set(letters)), None)


def battery(run: str, encoding: str) -> float:
    """Combined p-value of "drawn uniformly and independently from the alphabet"."""
    place = _PLACE[encoding]
    x = np.fromiter((place[c] for c in run.rstrip("=")), np.float64)
    n, size = len(x), len(place)
    classes = max(2, min(size, n // 5))
    edges = np.floor(np.arange(classes + 1) * size / classes)
    seen = np.histogram(x, edges - 0.5)[0]
    expect = n * np.diff(edges) / size
    p_chi = _chi2_tail(float(((seen - expect) ** 2 / expect).sum()), classes - 1)
    high = x >= size / 2
    n1, n0 = int(high.sum()), int(n - high.sum())
    if n1 and n0 and n > 2:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * n1 * n0 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - x.mean()
    whole = float((d * d).sum())
    p_serial = _normal_tail((float((d[1:] * d[:-1]).sum()) / whole + 1 / n) * math.sqrt(n)) if whole > 0 else 0.0
    # letter pairs and case patterns of ordinary words: how often the kind of character changes
    kind = np.array([0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in run.rstrip("=")])
    share = np.bincount(np.array([0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in place]), minlength=4) / size
    stay = float((share**2).sum())
    changes = int((kind[1:] != kind[:-1]).sum())
    sd = math.sqrt((n - 1) * stay * (1 - stay)) if 0 < stay < 1 else 0
    p_runs = min(1.0, 2 * min(p_runs, _normal_tail((changes - (n - 1) * (1 - stay)) / sd) if sd else 1.0))
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return max(_chi2_tail(fisher, 6), 1e-300)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the three fixed patterns, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in ("pass", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


#: Runs of HEX are maximal, so asking for the length in the pattern finds the same ones.
_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX)


def parts(run: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what is judged of an unbroken run: no "=" within, and one alphabet each."""
    body = run.rstrip("=")
    for m in _PART.finditer(body):
        part = run[m.start() :] if m.end() == len(body) else m[0]
        if infer_encoding(part):
            yield m.start(), m.start() + len(part)
            continue
        found = set()
        for pieces in _PIECES:
            for x in pieces.finditer(part):
                found.add((m.start() + x.start(), len(run) if m.start() + x.end() == len(body) else m.start() + x.end()))
        yield from sorted(found)


_PART = re.compile(r"[^=]+")
_PIECES = tuple(re.compile(rf"[A-Za-z0-9{more}]+") for more in ("", "+/", "_-"))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
    """(start, end, encoding, p) of the parts of runs that the battery judges."""
    out, starts, reach = [], [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for m in CANDIDATE.finditer(text):
        for start, end in parts(m[0]):
            start, end, run = m.start() + start, m.start() + end, m[0][start:end]
            before = bisect_left(starts, end)
            if before and reach[before - 1] > start:
                continue
            encoding = infer_encoding(run)
            if encoding is None or any(map(str.isdigit, run)) + any(map(str.islower, run)) + any(map(str.isupper, run)) < 2:
                continue
            if len(run.rstrip("=")) >= LEAST[encoding]:
                out.append((start, end, encoding, battery(run, encoding)))
    return out


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def stratum(encoding: str, length: int) -> str:
    """Encoding and length class, a power of two."""
    return f"{encoding}:{min(20, length.bit_length())}"


def bin_of(p: float) -> int:
    return min(BINS - 1, int(-math.log10(p) * BINS / TOP))


@lru_cache(256)
def random_bins(name: str, draws: int = 2000, longest: int = 2048) -> np.ndarray:
    """Of random runs of a stratum, the share in the bins before each, by simulation from a fixed seed."""
    encoding, size = name.split(":")
    letters = list(_PLACE[encoding])
    low = 1 << (int(size) - 1)
    first, last = min(max(low, LEAST[encoding]), longest), min(2 * low - 1, longest)
    draw = np.random.default_rng(11)
    seen = np.zeros(BINS + 1)
    for n in draw.integers(first, max(first, last) + 1, draws):
        seen[bin_of(battery("".join(draw.choice(letters, n)), encoding)) + 1] += 1
    return seen.cumsum() / draws


def cut_offs(histogram: dict[tuple[str, int], int], alpha: float, miss: float) -> dict[str, int]:
    """For each stratum, the bin from which on candidates are taken for ordinary."""
    out = {}
    for name in {s for s, _ in histogram}:
        found = np.concatenate([[0], np.cumsum([histogram.get((name, b), 0) for b in range(BINS)])])
        share = random_bins(name)
        half, far = int(np.searchsorted(share, 0.5)), int(np.searchsorted(share, 1 - miss))
        ordinary = found - share * found[half] / share[half]
        good = np.nonzero(ordinary[half : far + 1] <= alpha * found[half : far + 1] + 2 * np.sqrt(found[half : far + 1]))[0]
        out[name] = half + int(good[-1])
    return out


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.05, miss: float = 0.05) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    alpha: the share of ordinary runs allowed among those that the battery reports.
    miss: the share of random runs that may be given up. Runs one job first, for the
    histogram of p-values.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}
        for batch in batches:
            for t in batch.column(0):
                text = t.as_py() or ""
                if CANDIDATE.search(text):
                    for start, end, encoding, p in candidates(text, base_spans(text)):
                        at = stratum(encoding, end - start), bin_of(p)
                        seen[at] = seen.get(at, 0) + 1
        yield pa.RecordBatch.from_pydict({"stratum": pa.array([s for s, _ in seen], pa.string()), "bin": pa.array([b for _, b in seen], pa.int32()), "n": pa.array(list(seen.values()), pa.int64())})

    histogram = {(r[0], r[1]): r[2] for r in rows.select("text").mapInArrow(measure, "stratum string, bin int, n bigint").groupBy("stratum", "bin").agg(F.sum("n")).collect()}
    ordinary_from = cut_offs(histogram, alpha, miss)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, spans, more = ([], [], []), [], [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                random = [(s, 3, e) for s, e in joined([(s, e) for s, e, encoding, p in (candidates(text, base) if CANDIDATE.search(text) else ()) if bin_of(p) < ordinary_from[stratum(encoding, e - s)]])]
                names = (*KINDS, "random")
                said = lambda found: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in found)
                for k, column in enumerate(counts):
                    column.append(sum(x[1] == k for x in base))
                shas.append(hashlib.sha256(said(base).encode()).hexdigest())
                spans.append(said(sorted(base + random)))
                more.append(len(random))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return rows.mapInArrow(scan, f"doc_id {kind.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint")
