"""A small causal self-attention model in numpy, over subword ids.

The next id is predicted in two steps, p(class | context) and p(id | class,
state of the id before). The most frequent ids are classes of their own, so
attention gives their probabilities itself; all other ids share classes. The
first step is a single attention layer: query, key and value of an id are rows
of learnt tables, a learnt bias for each distance stands for positions, and the
attended value, plus the logarithm of how often the class follows the current
id, gives the logits of the classes. The second step, and that logarithm, are
counts over the whole corpus, smoothed.

Ids are grouped to classes and states by k-means over their neighbours' counts.
The layer is trained on every id of the texts to learn from, in windows that
stand back to back: tasks train copies of the model on their own windows and the
copies are averaged, a table's row by how often each task saw it, for some
rounds, each with its share of the windows.

Scoring cuts texts into windows of ``window`` inputs that overlap by
``window - stride``: each id is scored once, in the window in which it has most
context, and windows are computed in batches under a causal mask.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np


@dataclass(frozen=True)
class AttentionRules:
    #: Rows of the tables: one for each of the most frequent ids, and one for each class that its other ids share.
    rows: int = 4096
    dims: int = 16
    #: The most frequent ids, each a class and a state of its own.
    heads: int = 48
    classes: int = 96
    states: int = 128
    #: The most frequent ids that tell ids apart as neighbours.
    neighbours: int = 200
    window: int = 24
    stride: int = 16
    #: None: training windows stand back to back, and the rounds share them out, so that every id is trained on once.
    #: A number: in each round a text gives a window for so many of its ids, and one at least (trials on small tables).
    every: int | None = None
    rounds: int = 2
    batch: int = 64
    rate: float = 0.1
    #: Weight of p(id | class) against the counts of (state, id).
    prior: float = 20.0
    seed: int = 7


@dataclass
class Model:
    row: np.ndarray  # id -> row of the tables
    cls: np.ndarray  # id -> class
    state: np.ndarray  # id -> state
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    distance: np.ndarray  # bias of each distance in ids
    out: np.ndarray  # value -> classes
    direct: np.ndarray  # row -> classes


#: The tables of a Model that are trained: those with a row for each id, and the others.
BY_ROW, WHOLE = ("query", "key", "value"), ("distance", "out")


def arrays(model: Model) -> dict[str, np.ndarray]:
    return {f.name: getattr(model, f.name) for f in fields(model)}


def _by_row(model: Model) -> np.ndarray:
    """Query, key and value of each row, side by side."""
    return np.concatenate([np.asarray(getattr(model, k), np.float32) for k in BY_ROW], axis=1)


def _groups(x: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """k-means from the first k rows."""
    if not len(x):
        return np.zeros(0, np.int64)
    centre = x[np.arange(k) % len(x)].copy()
    own = np.zeros(len(x), np.int64)
    for _ in range(12):
        own = np.concatenate([(2 * x[a : a + 8192] @ centre.T - (centre**2).sum(1)).argmax(1) for a in range(0, len(x), 8192)])
        total = np.bincount(own, weights=weight, minlength=k)
        for g in np.flatnonzero(total).tolist():
            mine = own == g
            centre[g] = (x[mine] * weight[mine, None]).sum(0) / total[g]
    return own


def grouped(count: np.ndarray, near: np.ndarray, rules: AttentionRules) -> Model:
    """An untrained model. count: of each id; near: (ids, 2 * neighbours) counts of the most frequent ids before and after each."""
    v = len(count)
    order = np.argsort(-count, kind="stable")
    used = int((count > 0).sum())
    heads = min(rules.heads, max(0, used - 1))
    x = np.sqrt(near / (near.sum(1, keepdims=True) + 5.0)).astype(np.float32)[order]
    weight = np.sqrt(count[order] + 0.01)
    place: dict[str, np.ndarray] = {}
    for name, k in (("cls", rules.classes), ("state", rules.states)):
        own = np.arange(v)
        own[heads:used] = heads + _groups(x[heads:used], weight[heads:used], k - heads)
        own[used:] = k - 1  # ids that never occur
        place[name] = np.empty(v, np.int32)
        place[name][order] = own
    rank = np.empty(v, np.int64)
    rank[order] = np.arange(v)
    own_rows = rules.rows - rules.classes
    row = np.where(rank < own_rows, rank, own_rows + place["cls"]).astype(np.int32)
    rng = np.random.default_rng(rules.seed)
    tables = {k: rng.normal(0, 0.3, (rules.rows, rules.dims)).astype(np.float32) for k in BY_ROW}
    return Model(
        row, place["cls"], place["state"], **tables, distance=np.zeros(rules.window, np.float32), out=rng.normal(0, 0.1, (rules.dims, rules.classes)).astype(np.float32),
        direct=np.zeros((rules.rows, rules.classes), np.float32),
    )


def with_direct(model: Model, follow: np.ndarray) -> Model:
    """The model with the logarithm of how often each class follows each row, from counts (rows, classes)."""
    overall = follow.sum(0) + 0.05
    share = (follow + 10 * overall / overall.sum()) / (follow.sum(1, keepdims=True) + 10)
    return Model(**arrays(model) | {"direct": np.log(share).astype(np.float32)})


def training_windows(sizes: np.ndarray, phase: float, every: int) -> np.ndarray:
    """Places where the windows of texts begin (ids in each text given): one for each ``every`` ids, one at least, evenly spread."""
    n = np.maximum(1, sizes // every)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(np.cumsum(sizes) - sizes, n)
    return first + np.floor((k + phase) * np.repeat(sizes / n, n)).astype(np.int64)


def back_to_back(part: int, parts: int, size: int, width: int) -> np.ndarray:
    """Places of every ``parts``-th window of a stream of so many ids, from window ``part``: over all parts each id is in one."""
    return np.arange(part * width, size, parts * width)


def _row_sums(x: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of each one's values (float32, an even number of columns)."""
    order = np.argsort(x.astype(np.uint16) if int(x.max(initial=0)) < 65536 else x, kind="stable")  # short ones are sorted by radix
    x = x[order]
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    pairs = values.view(np.complex64).take(order, axis=0)  # two columns are added as one complex number: half as many short loops
    return x[first], np.add.reduceat(pairs, first).view(np.float32)


def _in_range(sums: np.ndarray) -> bool:
    """Whether sums of exponentials have neither run over nor under; nothing but these needs a maximum taken off the logits first."""
    return bool(sums.min() > 1e-25 and sums.max() < 1e25)


def train(model: Model, batches: Iterator[tuple[np.ndarray, np.ndarray]], rules: AttentionRules) -> tuple[dict[str, np.ndarray], np.ndarray, int]:
    """Trained tables, how often each row was seen, windows: gradient steps (Adagrad) over batches of inputs and wanted classes, each (windows, window)."""
    length, d, classes = rules.window, rules.dims, rules.classes
    by_row = _by_row(model)  # one table: rows are read and written once
    if d % 2:
        by_row = np.pad(by_row, ((0, 0), (0, 1)))  # _row_sums adds pairs of columns
    width = by_row.shape[1]
    p = {k: np.array(getattr(model, k), np.float32) for k in WHOLE}
    squares = {k: np.full_like(w, 1e-4) for k, w in p.items()}
    row_squares = np.full_like(by_row, 1e-4)
    seen, n = np.zeros(rules.rows, np.int64), 0
    t, j = np.mgrid[:length, :length]
    mask, gap = np.where(j <= t, 0, -1e9).astype(np.float32), np.abs(t - j)
    one_s, one_z, one_d = (np.ones(k, np.float32) for k in (length, classes, d))  # sums as products: faster over short rows
    most = rules.batch * length
    logits, follow, at = np.empty((most, classes), np.float32), np.empty((most, classes), np.float32), np.arange(most) * classes

    def step(name: str, g: np.ndarray) -> None:
        squares[name] += g * g
        p[name] -= rules.rate * g / np.sqrt(squares[name])

    def one_batch(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal logits, follow, at, seen, n
        rows = x.ravel()
        each = len(rows)
        if each > len(logits):
            logits, follow, at = np.empty((each, classes), np.float32), np.empty((each, classes), np.float32), np.arange(each) * classes
        qkv = by_row.take(rows, axis=0).reshape(-1, length, width)
        q, k, v = (qkv[..., i * d : (i + 1) * d] for i in range(3))
        bias = p["distance"][gap] + mask
        s = q @ k.transpose(0, 2, 1)
        s += bias
        np.exp(s, out=s)
        total = s @ one_s
        if not _in_range(total):
            s = q @ k.transpose(0, 2, 1) + bias
            s -= s.max(2, keepdims=True)
            np.exp(s, out=s)
            total = s @ one_s
        share = (1 / total)[..., None]
        o = s @ v
        o *= share
        flat, z = o.reshape(each, d), logits[:each]
        np.matmul(flat, p["out"], out=z)  # one product for all windows
        z += model.direct.take(rows, axis=0, out=follow[:each], mode="clip")
        np.exp(z, out=z)
        total = z @ one_z  # the gradient is z / total, less one at the wanted class, over all places
        if not _in_range(total):
            z = flat @ p["out"] + model.direct[rows]
            z -= z.max(1, keepdims=True)
            np.exp(z, out=z)
            total = z @ one_z
        z.reshape(-1)[at[:each] + y.ravel()] -= total
        scale = (1 / (each * total))[:, None]
        do = z @ p["out"].T
        do *= scale
        g_out = (z.T @ (flat * scale)).T
        do = do.reshape(o.shape)
        do *= share  # s is not divided by its sums: what it is multiplied with is
        ds = do @ v.transpose(0, 2, 1)
        ds -= ((do * o) @ one_d)[..., None]
        ds *= s
        g = np.empty_like(qkv)
        g[..., 3 * d :] = 0
        for i, (left, right) in enumerate(((ds, k), (ds.transpose(0, 2, 1), q), (s.transpose(0, 2, 1), do))):
            np.matmul(left, right, out=g[..., i * d : (i + 1) * d])
        step("out", g_out)
        step("distance", np.bincount(gap.ravel(), weights=ds.sum(0).ravel(), minlength=length).astype(np.float32))
        own, g = _row_sums(rows, g.reshape(each, width))
        squared = row_squares.take(own, axis=0)
        squared += g * g
        row_squares[own] = squared
        g *= rules.rate
        g /= np.sqrt(squared, out=squared)
        by_row[own] = by_row.take(own, axis=0) - g
        seen += np.bincount(rows, minlength=rules.rows)
        n += len(x)

    with np.errstate(over="ignore"):  # what runs over is computed again
        for x, y in batches:
            one_batch(x, y)
    return {k: by_row[:, i * d : (i + 1) * d] for i, k in enumerate(BY_ROW)} | p, seen, n


def weighted(tables: dict[str, np.ndarray], seen: np.ndarray, n: int) -> np.ndarray:
    """One vector that adds up over tasks: windows, rows seen, and the tables times these."""
    parts = [np.array([n], np.float64), seen.astype(np.float64)]
    parts += [(tables[k].astype(np.float64) * seen[:, None]).ravel() for k in BY_ROW] + [tables[k].astype(np.float64).ravel() * n for k in WHOLE]
    return np.concatenate(parts)


def averaged(model: Model, total: np.ndarray) -> Model:
    """The model with the tables whose weighted sums are given; rows that no task saw stay."""
    n, seen, at = total[0], total[1 : 1 + len(model.query)], 1 + len(model.query)
    new = arrays(model)
    for name in BY_ROW + WHOLE:
        old = new[name]
        own = total[at : at + old.size].reshape(old.shape)
        at += old.size
        by = np.broadcast_to(seen[:, None], old.shape) if name in BY_ROW else np.full(old.shape, n)
        new[name] = np.where(by > 0, own / np.maximum(by, 1), old).astype(np.float32)
    return Model(**new)


def class_logs(model: Model, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, start_id: int, rules: AttentionRules, windows: int = 128) -> np.ndarray:
    """ln p(class of each id | ids before it in its text). starts, lengths: of the texts in ids, one after another."""
    length, stride = rules.window, rules.stride
    ahead = length - stride
    x = np.full(ahead + len(ids) + length, model.row[start_id], np.int32)  # inputs: the id before; a text's first input is start_id
    x[ahead + 1 : ahead + 1 + len(ids)] = model.row[ids]
    x[ahead + starts[lengths > 0]] = model.row[start_id]
    per_text = -(-lengths // stride)
    text = np.repeat(np.arange(len(lengths)), per_text)
    at = starts[text] + stride * (np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text))
    out = np.empty(len(ids), np.float32)
    cls = np.append(model.cls[ids], np.zeros(stride, model.cls.dtype))
    inputs, classes = (np.lib.stride_tricks.sliding_window_view(v, n) for v, n in ((x, length), (cls, stride)))  # by a window's first scored place
    t, j = np.mgrid[ahead:length, :length]
    bias = np.where(j <= t, model.distance[np.clip(t - j, 0, length - 1)], np.float32(-1e9)).astype(np.float32)
    ends = starts + lengths
    # with logits bounded like this, exp() needs no maximum taken off first
    norm = lambda t, axis: float(np.sqrt((t * t).sum(axis)).max())
    small_s = norm(model.query, 1) * norm(model.key, 1) + float(np.abs(model.distance).max()) < 60
    pull = norm(model.value, 1) * norm(model.out, 0)
    small_z = pull < 40 and float(model.direct.max()) < 20 and float(model.direct.max(1).min()) > -20
    one_s, one_z = np.ones(length, np.float32), np.ones(rules.classes, np.float32)  # sums as products: faster over short rows
    by_row, d = _by_row(model), rules.dims
    back, on, flat = np.arange(-ahead, stride), np.arange(stride), np.arange(windows * stride) * rules.classes
    logits, follow = (np.empty((windows * stride, rules.classes), np.float32) for _ in range(2))
    for w in range(0, len(at), windows):
        here = at[w : w + windows]
        row, wanted = inputs[here], classes[here]
        begin, left = starts[text[w : w + windows]], ends[text[w : w + windows]] - here
        qkv = by_row.take(row, axis=0)
        s = qkv[:, ahead:, :d] @ qkv[..., d : 2 * d].transpose(0, 2, 1)
        s += bias
        if (early := here - ahead < begin).any():
            s[early] += np.where(back < (begin - here)[early, None], np.float32(-1e9), np.float32(0))[:, None, :]
        if not small_s:
            s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        o = s @ qkv[..., 2 * d :]
        o /= (s @ one_s)[..., None]
        row, valid = row[:, ahead:], on < left[:, None]
        own = (here[:, None] + on)[valid]
        if 2 * len(own) > valid.size:  # nearly all: what lies beyond a text's end is left out after that
            o, row, wanted = o.reshape(-1, d), row.ravel(), wanted.ravel()
        else:
            o, row, wanted, valid = o[valid], row[valid], wanted[valid], np.ones((len(own), 1), bool)
        z = np.matmul(o, model.out, out=logits[: len(o)])  # one product for all windows
        z += model.direct.take(row, axis=0, out=follow[: len(o)], mode="clip")
        if not small_z:
            z -= z.max(1, keepdims=True)
        picked = z.reshape(-1)[flat[: len(z)] + wanted]
        np.exp(z, out=z)
        out[own] = (picked - np.log(z @ one_z))[valid.ravel()]
    return out
