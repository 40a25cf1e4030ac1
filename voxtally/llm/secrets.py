"""Secret scan: fixed patterns, and a character convolutional network over candidates.

A candidate is every run of at least 16 characters that keys are written with. The
network (numpy) sees the whole candidate, whatever its length, and the characters
around it: an embedding of the character and of its part (before, inside, after), one
convolution, the largest response inside and the largest outside, and a logistic
layer. It is trained on labelled findings of a bounded sample of documents: what the
patterns find, keys of other shapes set into contexts of the sample, and, as
negatives, the other candidates that are made of words or dates and ordinary long words, numbers,
paths and names. Candidates of which neither is known are not labelled. Scores are calibrated
on held-out findings, and the threshold is the highest one that still recalls the
required share of the held-out secrets that a scan would ask the network about.

Scanning is one map over the documents, nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import blocks

# The base patterns.
#   assign  (password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)
#   access  AKIA[A-Z0-9]+, 20 or more characters
#   hex     [0-9a-f]+, 24 or more characters
# The first letter comes first as a class, so that the search can skip other characters.
ASSIGN = re.compile(
    r"[pPsStTaA](?:(?<=[pP])[aA][sS][sS][wW](?:[oO][rR])?[dD]|(?<=[sS])[eE][cC][rR][eE][tT]"
    r"|(?<=[tT])[oO][kK][eE][nN]|(?<=[aA])[pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
MIN_VALUE = 6

KINDS = ("assign", "access", "hex", "model")
CONTEXT = 24
CHUNK = 512
# Characters that go through the network at once.
READ_AT_ONCE = 24_576

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, in order of start and then of kind.

    Runs of key or hexadecimal characters lie inside candidates, so only these are
    searched for them.
    """
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= MIN_VALUE]
    for run in CANDIDATE.finditer(text):
        a, b = run.span()
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b)]
    return sorted(found)


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Runs that hold a digit and a letter and that no span of ``taken`` touches."""
    out = []
    for run in CANDIDATE.finditer(text):
        value = run.group()
        if value.isalpha() or not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
            continue
        a, b = run.span()
        if all(b <= s or e <= a for s, _, e in taken):
            out.append((a, b))
    return out


class Network(NamedTuple):
    """Weights, calibration (scale, shift) and threshold on the calibrated probability."""

    letters: np.ndarray  # (128 + 1) x width: embedding of a character
    parts: np.ndarray  # 3 x width: before, inside, after
    filters: np.ndarray  # span * width x filters
    bias: np.ndarray
    out: np.ndarray  # 2 * filters
    shift: float
    calibration: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5


SPAN = 5


def _windows(net: Network, codes: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of the convolution, and its responses, for each position of (rows, length)."""
    x = net.letters[codes] + net.parts[parts]
    x[codes < 0] = 0
    pad = np.zeros((len(x), SPAN // 2, x.shape[2]), x.dtype)
    x = np.concatenate([pad, x, pad], axis=1)
    views = np.lib.stride_tricks.sliding_window_view(x, SPAN, axis=1)  # rows, length, width, span
    flat = np.ascontiguousarray(views.transpose(0, 1, 3, 2)).reshape(len(x), codes.shape[1], -1)
    return flat, np.maximum(flat @ net.filters + net.bias, 0)


def _pooled(response: np.ndarray, codes: np.ndarray, parts: np.ndarray):
    inside = (parts == 1) & (codes >= 0)
    outside = (parts != 1) & (codes >= 0)
    a = np.where(inside[..., None], response, 0)
    b = np.where(outside[..., None], response, 0)
    return a, b


def _coded(before: str, value: str, after: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    text = before[-CONTEXT:] + value + after[:CONTEXT]
    codes = np.full(width, -1, np.int64)
    codes[: len(text)] = np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 128)
    parts = np.zeros(width, np.int64)
    a = len(before[-CONTEXT:])
    parts[a : a + len(value)] = 1
    parts[a + len(value) :] = 2
    return codes, parts


def scores(net: Network, rows: list[tuple[str, str, str]]) -> np.ndarray:
    """Calibrated probabilities of (before, value, after) rows.

    A value longer than ``CHUNK`` is read in overlapping chunks; the largest responses
    are those of the whole value, as a convolution sees ``SPAN`` characters at a time.
    """
    filters = net.filters.shape[1]
    inside = np.zeros((len(rows), filters), np.float32)
    outside = np.zeros((len(rows), filters), np.float32)
    jobs: dict[int, list] = {}

    def read(some: list) -> None:
        codes, parts = np.stack([j[1] for j in some]), np.stack([j[2] for j in some])
        a, b = _pooled(_windows(net, codes, parts)[1], codes, parts)
        at = [j[0] for j in some]
        np.maximum.at(inside, at, a.max(1).astype(np.float32))
        np.maximum.at(outside, at, b.max(1).astype(np.float32))

    for i, (before, value, after) in enumerate(rows):
        step = CHUNK - SPAN + 1
        for at in range(0, max(1, len(value) - SPAN + 1), step):
            part = value[at : at + CHUNK]
            # Chunks after the first are led in by the value, not by the context.
            first, last = at == 0, at + CHUNK >= len(value)
            width = -(-(len(part) + 2 * CONTEXT) // 32) * 32
            coded = _coded(before if first else "", part, after if last else "", width)
            waiting = jobs.setdefault(width, [])
            waiting.append((i, *coded))
            # Read as soon as there are enough, so that long values take no more memory than short ones.
            if len(waiting) * width >= READ_AT_ONCE:
                read(jobs.pop(width))
    for waiting in jobs.values():
        read(waiting)
    logits = np.concatenate([inside, outside], axis=1) @ net.out + net.shift
    scale, shift = net.calibration
    return 1 / (1 + np.exp(-np.clip(scale * logits + shift, -60, 60)))


def train(
    rows: list[tuple[str, str, str]],
    labels: Iterable[int],
    recall: float = 0.95,
    width: int = 12,
    filters: int = 32,
    epochs: int = 8,
    seed: int = 17,
) -> Network:
    """Fit on two thirds of the rows, calibrate and set the threshold on the rest.

    Values are cut to ``CHUNK`` characters for training only. Without both kinds of
    labels on each side the network is one whose threshold nothing passes.
    """
    y = np.asarray(list(labels), np.float64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    fit, held = order[: 2 * len(rows) // 3], order[2 * len(rows) // 3 :]
    params = {
        "letters": rng.normal(0, 0.3, (130, width)),
        "parts": rng.normal(0, 0.3, (3, width)),
        "filters": rng.normal(0, (2 / (SPAN * width)) ** 0.5, (SPAN * width, filters)),
        "bias": np.zeros(filters),
        "out": rng.normal(0, 0.1, 2 * filters),
        "shift": np.zeros(1),
    }

    def network(**more) -> Network:
        p = {k: v for k, v in params.items() if k != "shift"}
        return Network(**p, shift=float(params["shift"][0]), **more)

    if min(len(set(y[fit])), len(set(y[held]))) < 2:
        return network(threshold=2.0)
    size = max(len(a[-CONTEXT:] + v[:CHUNK] + b[:CONTEXT]) for a, v, b in rows)
    coded = [_coded(a, v[:CHUNK], b, size) for a, v, b in rows]
    codes, parts = np.stack([c for c, _ in coded]), np.stack([p for _, p in coded])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    weight = np.where(y == 1, 0.5 / max(y[fit].mean(), 1e-6), 0.5 / max(1 - y[fit].mean(), 1e-6))
    step = 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for k in range(0, len(fit), 64):
            batch = fit[k : k + 64]
            net = network()
            c, p = codes[batch], parts[batch]
            used = max(SPAN, int((c >= 0).sum(1).max()))
            c, p = c[:, :used], p[:, :used]
            flat, response = _windows(net, c, p)
            a, b = _pooled(response, c, p)
            ia, ib = a.argmax(1), b.argmax(1)
            pa_, pb = a.max(1), b.max(1)
            features = np.concatenate([pa_, pb], axis=1)
            logit = features @ params["out"] + params["shift"]
            error = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y[batch]) * weight[batch] / len(batch)
            grads = {"out": features.T @ error, "shift": np.array([error.sum()])}
            back = np.zeros_like(response)
            rows_at, f_at = np.arange(len(batch))[:, None], np.arange(filters)[None, :]
            np.add.at(back, (rows_at, ia, f_at), error[:, None] * params["out"][:filters] * (pa_ > 0))
            np.add.at(back, (rows_at, ib, f_at), error[:, None] * params["out"][filters:] * (pb > 0))
            grads["filters"] = flat.reshape(-1, flat.shape[2]).T @ back.reshape(-1, filters)
            grads["bias"] = back.sum((0, 1))
            source = (back @ params["filters"].T).reshape(len(batch), used, SPAN, width)
            dx = np.zeros((len(batch), used + SPAN - 1, width))
            for j in range(SPAN):
                dx[:, j : j + used] += source[:, :, j]
            dx = dx[:, SPAN // 2 : SPAN // 2 + used]
            dx[c < 0] = 0
            grads["letters"], grads["parts"] = np.zeros_like(params["letters"]), np.zeros_like(params["parts"])
            np.add.at(grads["letters"], c, dx)
            np.add.at(grads["parts"], p, dx)
            step += 1
            for name, g in grads.items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                params[name] = params[name] - rate * m / (np.sqrt(v) + 1e-8)
    raw = np.clip(scores(network(), [rows[i] for i in held]), 1e-9, 1 - 1e-9)
    logits = np.log(raw / (1 - raw))
    scale, shift = _platt(logits, y[held])
    calibrated = 1 / (1 + np.exp(-np.clip(scale * logits + shift, -60, 60)))
    # What the patterns find, or what is no candidate, is never asked and says nothing of recall.
    asked = np.array([_asked(*rows[i]) for i in held]) & (y[held] == 1)
    secret = np.sort(calibrated[asked if asked.any() else y[held] == 1])[::-1]
    threshold = float(secret[max(0, int(np.ceil(recall * len(secret))) - 1)])
    return network(calibration=(scale, shift), threshold=threshold)


def _platt(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logits by Newton steps on the log loss, slightly damped."""
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        move = np.linalg.solve(hessian, x.T @ (p - y) + 1e-2 * (w - [1.0, 0.0]))
        w = w - move
        if abs(move).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def _asked(before: str, value: str, after: str) -> bool:
    """Whether a scan of the row would ask the network about just this value."""
    text, a = before + value + after, len(before)
    return (a, a + len(value)) in candidates(text, base_spans(text))


_WIDE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_SMALL = "abcdefghijklmnopqrstuvwxyz0123456789"


def _other_key(rng: random.Random) -> str:
    """A value shaped like keys that the base patterns do not know."""

    def draw(n: int, letters: str = _WIDE) -> str:
        return "".join(rng.choice(letters) for _ in range(n))

    return rng.choice(
        [
            lambda: "ghp_" + draw(36),
            lambda: "sk_live_" + draw(rng.randint(24, 48)),
            lambda: "xoxb-" + draw(11, "0123456789") + "-" + draw(24),
            lambda: "eyJ" + draw(rng.randint(20, 60)) + "." + draw(rng.randint(30, 80)) + "." + draw(43),
            lambda: draw(40, _WIDE + "+/"),
            lambda: draw(rng.randint(20, 64)),
            lambda: draw(rng.randint(24, 64), "0123456789ABCDEF"),
            lambda: draw(rng.randint(40, 160), _WIDE + "+/") + "==",
            lambda: draw(rng.randint(24, 64), _SMALL),
            lambda: draw(rng.randint(3, 6), _SMALL[:26]) + rng.choice("-_") + draw(rng.randint(20, 40)),
        ]
    )()


def _plain_run(rng: random.Random, words: list[str]) -> str:
    """A long run without a secret: joined words with numbers, paths, dates, versions, names."""
    pick = lambda: rng.choice(words)
    number = lambda n=4: str(rng.randint(1, 10**n))
    value = rng.choice(
        [
            lambda: "/".join([pick(), pick(), pick(), number()]),
            lambda: "-".join([pick(), number(), pick(), pick()]),
            lambda: "_".join([pick(), pick(), number(2), pick()]),
            lambda: "2024-01-" + number(1) + "T00/" + pick() + "." + pick(),
            lambda: "www." + pick() + number(3) + "." + pick() + ".com/" + pick(),
            lambda: pick() + pick() + pick() + number(2),
            lambda: ".".join([number(2), number(2), number(3), pick(), pick()]),
            lambda: "-".join([number(3), number(3), number(4), "ext" + number(3)]),
        ]
    )()
    return value if len(value) >= 16 else value + "-" + pick() + "-" + pick() + number(3)


DATED = re.compile(r"[0-9.:/_+-]*[0-9]{1,4}([-/.][0-9]{1,2}){2}(T[0-9:.+-]*Z?)?[./_+-]*")
WORD = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z]{3,}(?![A-Za-z0-9+/_=-])")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def ordinary(value: str, words: set[str]) -> bool:
    """Whether a run is made of a date, or of known words for four fifths of its letters and half of it."""
    if DATED.fullmatch(value):
        return True
    parts = PART.findall(value)
    known = sum(len(p) for p in parts if len(p) >= 3 and p.lower() in words)
    return 5 * known >= 4 * sum(map(len, parts)) and 2 * known >= len(value)


def labelled_findings(texts: list[str], seed: int = 23) -> tuple[list[tuple[str, str, str]], list[int]]:
    """Findings of sampled texts as (before, value, after) rows with labels.

    Secrets: what the base patterns find, and one value of another shape set between
    two words of each text. Not secrets: the other candidates that are ``ordinary`` in the
    words of two texts or more, and one ordinary run set into each text in the same way, so
    the context alone decides nothing. The other candidates may be secrets of shapes that
    the patterns do not know, and get no label.
    """
    rng = random.Random(seed)
    rows, labels = [], []
    words = [w for t in texts for w in t.split()[:50] if w.isascii() and w.isalpha() and 3 <= len(w) <= 12]
    words = words or ["word", "other", "third"]
    seen = Counter(w for t in texts for w in {w.lower() for w in WORD.findall(t)})
    common = {w for w, n in seen.items() if n > 1}
    for text in texts:
        spans = base_spans(text)
        for a, kind, b in spans:
            if kind == 0:
                m = ASSIGN.match(text, a)
                a = m.start(1) if m else a
            rows.append((text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT]))
            labels.append(1)
        for a, b in candidates(text, spans):
            if ordinary(text[a:b], common):
                rows.append((text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT]))
                labels.append(0)
        gaps = [m.end() for m in re.finditer(" ", text)]
        for value, label in ((_other_key(rng), 1), (_plain_run(rng, words), 0)):
            at = rng.choice(gaps) if gaps else 0
            name = rng.choice(["", "", "", "key ", "id: ", "ref=", "see ", "auth "])
            rows.append((text[max(0, at - CONTEXT) : at] + name, value, " " + text[at : at + CONTEXT]))
            labels.append(label)
    return rows, labels


def fit_network(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    sample: int = 1500,
    recall: float = 0.95,
    stretch: int = 200_000,
) -> Network:
    """Train on the ``sample`` documents whose keys come first in a seeded order.

    Only the network is fitted on a bounded sample; scanning reads every document. The
    ids are chosen from the key column alone, then their texts are read, one for each id;
    of a text longer than ``stretch`` characters, so many of them from a seeded place.
    """
    ids = docs.select(F.col(key).cast("long").alias(key)).filter(F.col(key).isNotNull())
    ids = ids.distinct().orderBy(F.xxhash64(F.lit(7), key), key).limit(sample)
    # At most ``sample`` rows of ``stretch`` characters: a proven bound for the broadcast and for the driver.
    t = F.col(text).cast("string")
    place = F.pmod(F.xxhash64(F.lit(8), key), F.greatest(F.length(t) - stretch, F.lit(1))) + 1
    cut = F.when(F.length(t) > stretch, F.substring(t, place.cast("int"), stretch)).otherwise(t)
    chosen = docs.select(F.col(key).cast("long").alias(key), cut.alias("t"))
    found = chosen.join(F.broadcast(ids), key, "left_semi").groupBy(key).agg(F.min("t").alias("t")).toArrow()
    texts = [t or "" for t in found.sort_by(key).column("t").to_pylist()]
    return train(*labelled_findings(texts), recall=recall)


def _scanner(key: str, text: str, net: Network):
    def scan(batches):
        for block in blocks(batches, text, 4 << 20):
            texts = [t or "" for t in block.column(text).to_pylist()]
            found = [base_spans(t) for t in texts]
            where, rows = [], []
            for i, t in enumerate(texts):
                for a, b in candidates(t, found[i]):
                    where.append((i, a, b))
                    rows.append((t[max(0, a - CONTEXT) : a], t[a:b], t[b : b + CONTEXT]))
            added: list[list[Span]] = [[] for _ in texts]
            if rows:
                for (i, a, b), p in zip(where, scores(net, rows).tolist()):
                    if p >= net.threshold:
                        added[i].append((a, 3, b))
            columns: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for base, more in zip(found, added):
                for kind, name in enumerate(("n_assign", "n_access", "n_hex")):
                    columns[name].append(sum(k == kind for _, k, _ in base))
                columns["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                columns["spans"].append(_joined(sorted(base + more)))
            yield pa.RecordBatch.from_arrays(
                [block.column(key), *(pa.array(c, pa.int64()) for c in list(columns.values())[:3])]
                + [pa.array(c, pa.string()) for c in list(columns.values())[3:]],
                ["doc_id", *columns],
            )

    return scan


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans), one per document.

    ``spans`` lists kind:start:end in code points, those of the network as ``model``; it
    adds candidates that touch no base span. A NULL or empty text has no spans. Rows come
    out as they are: repeated ones are repeated, and a NULL key stays. An
    empty table gives no rows; other columns are not read.
    """
    source = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    return source.mapInArrow(
        _scanner(key, text, net),
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )


def redact_secrets(docs: DataFrame, net: Network, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows with every found span replaced by ``mark``; spans that touch are one.

    A NULL text stays NULL. All other columns, and all rows, are kept as they are.
    """

    at = docs.columns.index(text)

    def redact(batches):
        for block in blocks(batches, text, 4 << 20):
            texts = block.column(text).to_pylist()
            found = [base_spans(t or "") for t in texts]
            asked = [(i, a, b) for i, t in enumerate(texts) for a, b in candidates(t or "", found[i])]
            rows = [
                (texts[i][max(0, a - CONTEXT) : a], texts[i][a:b], texts[i][b : b + CONTEXT])
                for i, a, b in asked
            ]
            for (i, a, b), p in zip(asked, scores(net, rows).tolist() if rows else []):
                if p >= net.threshold:
                    found[i].append((a, 3, b))
            out = [t if not s else _without(t, sorted(s), mark) for t, s in zip(texts, found)]
            columns = block.columns
            columns[at] = pa.array(out, block.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, block.schema.names)

    return docs.mapInArrow(redact, docs.schema)


def _without(text: str, spans: list[Span], mark: str) -> str:
    out, upto = [], 0
    for a, _, b in spans:
        if a >= upto:
            out += [text[upto:a], mark]
        upto = max(upto, b)
    return "".join([*out, text[upto:]])
