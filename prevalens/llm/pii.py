"""Personal data: base patterns plus a character bidirectional LSTM with CRF transitions.

Base spans (e-mail, IP address, card and telephone numbers) follow fixed
patterns.  The model is a character-level bidirectional LSTM whose emissions
feed a linear-chain CRF; it is trained in numpy on labelled spans: by default the
base spans of a bounded sample of windows (``MAX_TRAIN``, a parameter).  It reads
every text in overlapping windows.  Each window is decoded with the CRF; of the
windows that cover a character the one in which it lies nearest the centre
decides, and the decided labels of the whole text are joined to spans.

A span must hold a digit or an at sign, so a window without either can hold
none and is not computed; this is the definition of a span, not a sample.  A
model span is added where it overlaps no base span and has the loose shape of
its kind (``plausible``).  Base spans are never changed.

Edge cases: null text is empty and has no spans; texts shorter than a window are
one padded window; a corpus without base spans trains nothing and adds nothing;
very long texts are read whole, in bounded batches of windows; repeated rows are
scanned one by one; extra columns are ignored; spans that start together
are listed in the order of ``KINDS``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import slices

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
HIDDEN = 16
MAX_TRAIN = 2_000
MAX_TRAIN_DOCS = 6_000
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# every ip, card or telephone match lies inside one such run, so runs are searched one by one
_NUMERIC = re.compile(r"\+?[0-9][0-9+\x20().-]*")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOT = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list:
    """[(start, kind index, end)] sorted by start, then kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at and at >= end else None
        if found:
            end = found.end()
            out.append((start, 0, end))
        at = text.find("@", at + 1)
    for run in _NUMERIC.finditer(text):
        a, b = run.span()
        if b - a < 7:
            continue
        for m in _IP.finditer(text, a, b):
            # leading zeros go before the number is read: a part may have thousands of them
            parts = [x.lstrip("0") for x in m.group().split(".")]
            if all(len(x) < 4 and int(x or "0") <= 255 for x in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text, a, b):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text, a, b):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- characters, windows, labels -------------------------------------------------
_MARKS = " \n\t.,:;@_%+-()[]{}<>/\\|=\"'#*&$!?~"
N_SYMBOLS = 5 + len(_MARKS)
_CLASS = np.full(128, 4, dtype=np.int8)
_CLASS[48:58] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
for _i, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 5 + _i
N_TAGS = 1 + 2 * len(KINDS)             # outside, then begin and inside of every kind


def symbols(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(cp < 128, _CLASS[np.minimum(cp, 127)], np.where(cp > 0, 2, 4)).astype(np.int8)


def hot_windows(text: str) -> np.ndarray:
    """Starts of the windows (multiples of the stride) that hold a digit or an at sign."""
    at = np.fromiter((m.start() for m in _HOT.finditer(text)), dtype=np.int64)
    near = at // STRIDE
    return np.unique(np.concatenate([near, np.maximum(near - 1, 0)])) * STRIDE


def cut(x: np.ndarray, starts: np.ndarray, fill: int = 0) -> np.ndarray:
    """Windows of an array, padded at the end of the text."""
    padded = np.concatenate([x, np.full(WINDOW, fill, x.dtype)])
    return padded[np.minimum(starts[:, None] + np.arange(WINDOW), len(padded) - 1)]


def tag_array(n: int, spans: list) -> np.ndarray:
    tags = np.zeros(n, dtype=np.int8)
    for start, kind, end in spans:
        if not tags[start:end].any():
            tags[start] = 1 + 2 * kind
            tags[start + 1:end] = 2 + 2 * kind
    return tags


# ---- model ------------------------------------------------------------------------
def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def init(seed: int = 5, hidden: int = HIDDEN) -> dict:
    rng = np.random.default_rng(seed)
    p = {}
    for side in "fb":
        p[f"in_{side}"] = rng.normal(0, 0.3, (N_SYMBOLS, 4 * hidden))
        p[f"rec_{side}"] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 4 * hidden))
        p[f"bias_{side}"] = np.zeros(4 * hidden)
        p[f"bias_{side}"][hidden:2 * hidden] = 1.0
    p["out"] = rng.normal(0, 0.3, (2 * hidden, N_TAGS))
    p["out_bias"] = np.zeros(N_TAGS)
    p["move"] = np.zeros((N_TAGS, N_TAGS))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _lstm(p: dict, side: str, x: np.ndarray, tape: list | None = None) -> np.ndarray:
    """Hidden states (time, batch, hidden) of one direction; x is (batch, time)."""
    hidden = p[f"rec_{side}"].shape[0]
    table = p[f"in_{side}"] + p[f"bias_{side}"]
    h = np.zeros((len(x), hidden), np.float32)
    c = np.zeros_like(h)
    out = np.zeros((x.shape[1], len(x), hidden), np.float32)
    for t in (range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1)):
        z = table[x[:, t]] + h @ p[f"rec_{side}"]
        gates = _sigmoid(z[:, :3 * hidden])
        i, f, o = gates[:, :hidden], gates[:, hidden:2 * hidden], gates[:, 2 * hidden:]
        g = np.tanh(z[:, 3 * hidden:])
        before, h_before = c, h
        c = f * c + i * g
        squashed = np.tanh(c)
        h = o * squashed
        out[t] = h
        if tape is not None:
            tape.append((t, i, f, o, g, before, squashed, h_before))
    return out


def emissions(p: dict, x: np.ndarray, tapes: tuple = (None, None)) -> tuple[np.ndarray, np.ndarray]:
    """(hidden states of both directions, tag scores), time first."""
    states = np.concatenate([_lstm(p, "f", x, tapes[0]), _lstm(p, "b", x, tapes[1])], axis=2)
    return states, states @ p["out"] + p["out_bias"]


def viterbi(e: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best tag sequences (batch, time) for emissions (time, batch, tags)."""
    score, back = e[0], []
    for t in range(1, len(e)):
        all_ = score[:, :, None] + move
        back.append(all_.argmax(axis=1))
        score = all_.max(axis=1) + e[t]
    tag = score.argmax(axis=1)
    out = [tag]
    for b in reversed(back):
        tag = b[np.arange(len(tag)), tag]
        out.append(tag)
    return np.stack(out[::-1], axis=1)


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradient(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of the tags and its gradient."""
    n, steps, hidden = len(x), x.shape[1], p["rec_f"].shape[0]
    tapes = ([], [])
    states, e = emissions(p, x, tapes)
    alpha, beta = [e[0]], [np.zeros_like(e[0])]
    for t in range(1, steps):
        alpha.append(_lse(alpha[-1][:, :, None] + p["move"], 1) + e[t])
    for t in range(steps - 1, 0, -1):
        beta.append(_lse(p["move"] + (e[t] + beta[-1])[:, None, :], 2))
    beta = beta[::-1]
    norm = _lse(alpha[-1], 1)
    rows = np.arange(n)
    gold = sum(e[t][rows, y[:, t]] for t in range(steps)) + sum(
        p["move"][y[:, t - 1], y[:, t]] for t in range(1, steps))
    de = np.stack([np.exp(alpha[t] + beta[t] - norm[:, None]) for t in range(steps)])
    d_move = np.zeros_like(p["move"])
    for t in range(1, steps):
        both = alpha[t - 1][:, :, None] + p["move"] + (e[t] + beta[t])[:, None, :] - norm[:, None, None]
        d_move += np.exp(both).sum(axis=0)
        np.add.at(d_move, (y[:, t - 1], y[:, t]), -1)
    for t in range(steps):
        de[t][rows, y[:, t]] -= 1
    g = {"move": d_move, "out": np.einsum("tbh,tbk->hk", states, de), "out_bias": de.sum(axis=(0, 1))}
    d_states = de @ p["out"].T
    for side, tape, part in (("f", tapes[0], d_states[:, :, :hidden]), ("b", tapes[1], d_states[:, :, hidden:])):
        d_in, d_rec = np.zeros_like(p[f"in_{side}"]), np.zeros_like(p[f"rec_{side}"])
        dh, dc = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
        for t, i, f, o, gg, before, squashed, h_before in reversed(tape):
            dh = dh + part[t]
            dc = dc + dh * o * (1 - squashed ** 2)
            dz = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f),
                                 dh * squashed * o * (1 - o), dc * i * (1 - gg ** 2)], axis=1)
            np.add.at(d_in, x[:, t], dz)
            d_rec += h_before.T @ dz
            dh, dc = dz @ p[f"rec_{side}"].T, dc * f
        g[f"in_{side}"], g[f"rec_{side}"], g[f"bias_{side}"] = d_in, d_rec, d_in.sum(axis=0)
    return float((norm - gold).mean()), {k: v / n for k, v in g.items()}


def train(x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.02, batch: int = 64,
          seed: int = 3) -> dict:
    """Adam over shuffled batches."""
    p, rng, step = init(), np.random.default_rng(seed), 0
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            some = order[at:at + batch]
            _, g = gradient(p, x[some], y[some])
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9 ** step))
                        / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return p


def plausible(kind: int, text: str) -> bool:
    """The loose shape a model span must have."""
    digits = sum(c.isdigit() for c in text)
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", text))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}|[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){5,7}", text))
    if kind == 2:
        plain = re.sub(r"[ .-]", "", text)
        return plain.isdigit() and 12 <= digits <= 19 and luhn(plain)
    return 9 <= digits <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ().+/-]*[0-9]", text))


def model_spans(texts: list, model: dict, base: list, batch: int = 2048) -> list:
    """Per text the model's spans that overlap no base span."""
    starts = [hot_windows(t) if t else np.zeros(0, np.int64) for t in texts]
    out = [[] for _ in texts]
    todo = [i for i, s in enumerate(starts) if len(s)]
    if not todo:
        return out
    x = np.concatenate([cut(symbols(texts[i]), starts[i]) for i in todo])
    tags = np.concatenate([viterbi(emissions(model, x[a:a + batch])[1], model["move"])
                           for a in range(0, len(x), batch)])
    at = 0
    quarter = (WINDOW - STRIDE) // 2
    for i in todo:
        held = {}
        for s, row in zip(starts[i].tolist(), tags[at:at + len(starts[i])].tolist()):
            low = 0 if s == 0 else quarter
            for k in range(low, WINDOW - quarter):
                if row[k]:
                    held[s + k] = row[k]
        at += len(starts[i])
        text, run = texts[i], []
        for pos in sorted(held):
            kind, begin = (held[pos] - 1) // 2, held[pos] % 2 == 1
            if run and run[-1][2] == pos and run[-1][1] == kind and not begin:
                run[-1][2] = pos + 1
            else:
                run.append([pos, kind, pos + 1])
        for a, kind, b in run:
            while a < b and text[b - 1:b] in " .,;:":
                b -= 1
            if b <= len(text) and _HOT.search(text, a, b) and plausible(kind, text[a:b]) and not any(
                    a < e and s < b for s, _, e in base[i]):
                out[i].append((a, kind, b))
    return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = MAX_TRAIN,
        docs_limit: int = MAX_TRAIN_DOCS) -> dict | None:
    """Train on windows of a bounded sample of texts that hold a digit or an at sign."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(
        F.col("k").isNotNull() & F.col("t").rlike("[0-9@]"))
    chosen = rows.select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(docs_limit)

    def windows(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                xs, ys, names = [], [], []
                for k, t in zip(part.column("k").to_pylist(), part.column("t").to_pylist()):
                    tags, at = tag_array(len(t), base_spans(t)), hot_windows(t)
                    x, y = cut(symbols(t), at), cut(tags, at)
                    marked = y.any(axis=1)
                    some = np.flatnonzero(marked)[:4].tolist() + np.flatnonzero(~marked)[:1].tolist()
                    xs += [x[j].tobytes() for j in some]
                    ys += [y[j].tobytes() for j in some]
                    names += [f"{k}:{at[j]}" for j in some]
                yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()),
                                                  "x": pa.array(xs, pa.binary()), "y": pa.array(ys, pa.binary())})

    # at most ``docs_limit`` ids: broadcast is bounded by that parameter
    found = (rows.join(F.broadcast(chosen), "k").mapInArrow(windows, "name string, x binary, y binary")
             .orderBy(F.xxhash64("name"), "name", "x").limit(limit).collect())
    if not found:
        return None
    x, y = (np.frombuffer(b"".join(bytes(r[c]) for r in found), np.int8).reshape(-1, WINDOW).astype(np.int64)
            for c in ("x", "y"))
    return train(x, y) if y.any() else None


def detect(docs: DataFrame, model: dict | None, text: str = "text", keep: list | None = None) -> DataFrame:
    """``keep`` columns plus ``base`` and ``spans``: arrays of (start, kind, end), kinds by number."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "spans")]
    source = docs.select(*keep, F.col(text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "array<struct<start:long,kind:int,end:long>>"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]]
                       + [f"base {kind}", f"spans {kind}"])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def named(spans):
        return [{"start": s, "kind": k, "end": e} for s, k, e in spans]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = part.column("__text").fill_null("").to_pylist()
                base = [base_spans(t) for t in texts]
                more = model_spans(texts, shared.value, base) if shared.value else [[]] * len(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))]
                    + [pa.array([named(b) for b in base], arrow),
                       pa.array([named(sorted(b + m)) for b, m in zip(base, more)], arrow)],
                    names=keep + ["base", "spans"])

    return source.mapInArrow(run, schema)


def masked(text: str, spans: list) -> str:
    """The text with every span replaced by its kind in angle brackets; overlaps count as one."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """``docs`` with all spans of ``text`` masked; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in slices(batch, text):
                texts = part.column(at).to_pylist()
                known = [t or "" for t in texts]
                base = [base_spans(t) for t in known]
                more = model_spans(known, shared.value, base) if shared.value else [[]] * len(known)
                new = [t if t is None else masked(t, sorted(b + m)) for t, b, m in zip(texts, base, more)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) if i != at else pa.array(new, pa.string()) for i in range(part.num_columns)],
                    names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def listed(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def digest(spans: list) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()
