"""A small causal self-attention language model over subword ids, in numpy.

A word is its subword ids with a leading space. The first ids of the words of a text form one
stream, closed by an end id; the other ids of a word follow from that word alone, closed by a
stop. Both streams are scored by the same kind of model with parameters of their own, so what
lies inside a word is computed once per distinct word and not per occurrence.

Ids fall into classes: the most frequent ones are classes of their own, the others share bands of
equal frequency. The model predicts the class of the next id by one attention head over a causal
window, and the id within its class by its corpus frequency. Classes are predicted in two steps,
their group and their place in it, so the cost of a position is that of two short rows. Blocks of
``BLOCK`` positions are scored once each, and see the block before them as well: overlapping
windows of ``2 * BLOCK``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Words encoded at once.
RUN = 1024
BLOCK = 8
END = 50256
VOCABULARY = END + 1


def split_words(tokens, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First ids of the words, all other ids with a stop after each word, and their numbers.

    ``tokens`` has ``ids(text)`` and the flags ``spaced``. Words without white space of any kind
    are encoded many at a time: no id reaches over a space, so each word begins where one does.
    """
    parts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def encode(text: str, count: int) -> bool:
        """Take the ids of ``count`` words, unless they can't be told apart."""
        ids = tokens.ids(text).astype(np.int64)
        first = np.flatnonzero(tokens.spaced[ids]) if count > 1 else np.zeros(1, np.int64)
        if len(first) == count:
            parts.append(ids)
            sizes.append(np.diff(first, append=len(ids)))
        return len(first) == count

    def together(words: list[bytes]) -> None:
        """Halves of words until each is encoded, with its neighbours or alone."""
        lengths = [*map(len, words)]
        text = b" ".join(words).decode("utf-8", "replace")
        plain = min(lengths) > 0 and max(lengths) < 256 and text.isprintable() and "<|" not in text
        if (plain or len(words) == 1) and encode(" " + text, len(words)):
            return
        together(words[: len(words) // 2])
        together(words[len(words) // 2 :])

    for k in range(0, len(words), RUN):
        together(words[k : k + RUN])
    ids, size = np.concatenate(parts), np.concatenate(sizes)
    ends = np.cumsum(size)
    inner = np.append(ids[1:], END)
    inner[ends - 1] = END
    return ids[ends - size], inner[: len(ids)], size


@dataclass
class Classes:
    """Class of every id, and the log probability of the id within it."""

    of: np.ndarray
    within: np.ndarray
    prior: np.ndarray

    @property
    def count(self) -> int:
        return len(self.prior)


def make_classes(counts: np.ndarray, single: int = 992, bands: int = 32) -> Classes:
    """The ``single`` most frequent ids alone, the rest in bands of equal mass."""
    mass = counts + 0.1
    order = np.lexsort((np.arange(len(mass)), -mass))
    of = np.empty(len(mass), np.int64)
    of[order[:single]] = np.arange(min(single, len(mass)))
    rest = order[single:]
    share = np.cumsum(mass[rest]) / mass[rest].sum()
    of[rest] = single + np.minimum((share * bands).astype(np.int64), bands - 1)
    total = np.bincount(of, mass, single + bands)
    within = np.log(mass / total[of])
    smooth = total + 1e-3 * total.sum() / len(total)
    return Classes(of, within, np.log(smooth / smooth.sum()))


class Attention:
    """One head: query, key, value and direct tables by class, distance bias, two output layers.

    Input classes are shifted by one place; class ``count`` starts a text, ``count + 1`` pads.
    A class is predicted as a group of ``GROUP`` classes and a place in the group.
    """

    NAMES = ("query", "key", "value", "direct", "near", "out", "bias", "member", "place")
    GROUP = 32

    def __init__(self, classes: int, width: int = 16, params: np.ndarray | None = None, prior=None, seed: int = 3):
        self.classes, self.width, self.groups = classes, width, -(-classes // self.GROUP)
        rows = classes + 2
        self.shapes = {n: (rows, width) for n in self.NAMES[:4]} | {
            "near": (2 * BLOCK,),
            "out": (width, self.groups),
            "bias": (self.groups,),
            "member": (self.groups, width, self.GROUP),
            "place": (self.groups, self.GROUP),
        }
        if params is None:
            rng = np.random.default_rng(seed)
            parts = [rng.standard_normal(self.shapes[n]) * 0.3 for n in self.NAMES[:4]]
            log_prior = np.full(self.groups * self.GROUP, -30.0)
            log_prior[:classes] = -np.log(classes) if prior is None else prior
            share = np.exp(log_prior).reshape(self.groups, self.GROUP)
            parts += [np.zeros(2 * BLOCK), rng.standard_normal(self.shapes["out"]) * 0.1]
            parts += [np.log(share.sum(axis=1)), rng.standard_normal(self.shapes["member"]) * 0.1]
            parts.append(np.log(share / share.sum(axis=1, keepdims=True)))
            params = np.concatenate([p.ravel() for p in parts])
        self.params = params.astype(np.float32)
        self.p = self._views(self.params)
        self.padding = np.zeros(rows, np.float32)
        self.padding[-1] = -1e9
        later = np.arange(2 * BLOCK)[None, :] > np.arange(BLOCK)[:, None] + BLOCK
        self.distance = np.clip(np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :], 0, None)
        self.later = np.where(later, np.float32(-1e9), np.float32(0))
        self._rooms: dict[str, np.ndarray] = {}

    def _room(self, name: str, kind: np.dtype, *shape: int) -> np.ndarray:
        """An array to write to, in memory used again by the next call of the same name: fresh pages cost more than the sums."""
        size, held = math.prod(shape), self._rooms.get(name)
        if held is None or held.size < size or held.dtype != kind:
            held = self._rooms[name] = np.empty(size, kind)
        return held[:size].reshape(shape)

    def _taken(self, name: str, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of a table; ``at`` lies within it."""
        return table.take(at, 0, out=self._room(name, table.dtype, *at.shape, table.shape[1]), mode="clip")

    def _product(self, name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.matmul(a, b, out=self._room(name, a.dtype, *a.shape[:-1], b.shape[-1]))

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            size = int(np.prod(shape))
            out[name] = flat[at : at + size].reshape(shape)
            at += size
        return out

    def blocks(
        self, classes: np.ndarray, sizes: np.ndarray, starts: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys (two blocks of inputs), targets and mask of real targets, per block of a text.

        ``starts``: input class before the first target of each text.
        """
        pad, start = self.classes + 1, self.classes
        count = -(-sizes // BLOCK)
        first = np.cumsum(count) - count
        total = int(count.sum())
        place = np.arange(len(classes)) + np.repeat(first * BLOCK - (np.cumsum(sizes) - sizes), sizes)
        targets = np.zeros(total * BLOCK, np.int32)
        targets[place] = classes
        mask = np.zeros(total * BLOCK, bool)
        mask[place] = True
        inputs = np.full(total * BLOCK, pad, np.int32)
        inputs[1:][mask[1:]] = targets[:-1][mask[1:]]
        inputs[first[sizes > 0] * BLOCK] = start if starts is None else starts[sizes > 0]
        inputs = inputs.reshape(-1, BLOCK)
        before = np.full_like(inputs, pad)
        before[1:] = inputs[:-1]
        before[first[sizes > 0]] = pad
        return np.hstack([before, inputs]), targets.reshape(-1, BLOCK), mask.reshape(-1, BLOCK)

    def forward(self, keys: np.ndarray) -> tuple:
        """Scaled queries, keys, values, attention and outputs, to be used before the next call."""
        p, inputs = self.p, keys[:, BLOCK:]
        q, k, v = self._taken("q", p["query"], inputs), self._taken("k", p["key"], keys), self._taken("v", p["value"], keys)
        q *= q.dtype.type(self.width**-0.5)
        s = self._product("s", q, k.transpose(0, 2, 1))
        s += p["near"][self.distance] + self.later
        s += self.padding.take(keys)[:, None, :]
        np.exp(np.minimum(s, 60, out=s), out=s)
        s /= s.sum(axis=2, keepdims=True) + np.float32(1e-30)
        h = self._product("h", s, v)
        h += self._taken("direct", p["direct"], inputs)
        np.tanh(h, out=h)
        return q, k, v, s, h

    def _by_group(self, targets: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, slice]]]:
        """Asked positions in the order of their target's group, groups and places in this order, and the part of each group."""
        at = np.flatnonzero(asked)
        group = (targets.take(at) // self.GROUP).astype(np.int16)
        order = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=self.groups))
        parts = [(g, slice(a, b)) for g, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if b > a]
        group, order = group.take(order), at.take(order)
        return order, group, targets.take(order) % self.GROUP, parts

    def _layers(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of both output layers, their bias as a last row: inputs end with a one."""
        p = self.p
        return np.vstack([p["out"], p["bias"]]), np.concatenate([p["member"], p["place"][:, None]], axis=1)

    def _ordered(self, h: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Outputs in this order, each with a one behind it."""
        mine = self._room("mine", h.dtype, len(order), self.width + 1)
        mine[:, :-1] = self._taken("taken", h, order)
        mine[:, -1] = 1
        return mine

    def _exp(self, z: np.ndarray, layer: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the column ``at`` of each row lies, its log probability, and what a row of exponentials adds up to.

        Sums are replaced by their exponentials; inputs lie between -1 and 1, which bounds the sums.
        """
        if (np.abs(layer[..., :-1, :]).sum(axis=-2) + layer[..., -1, :]).max() > 80:
            z -= z.max(axis=1, keepdims=True)
        place = np.arange(0, z.size, z.shape[1])
        place += at
        chosen = z.reshape(-1).take(place)
        np.exp(z, out=z)
        total = z @ np.ones(z.shape[1], z.dtype)
        chosen -= np.log(total)
        return place, chosen, total

    def _sums(self, h: np.ndarray, layers: tuple[np.ndarray, np.ndarray], parts: list[tuple[int, slice]]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the layer of groups and, in its own group, of that of places."""
        groups, members = layers
        z = self._room("members", h.dtype, len(h), self.GROUP)
        for g, rows in parts:
            np.matmul(h[rows], members[g], out=z[rows])
        return self._product("groups", h, groups), z

    def log_probability(self, keys: np.ndarray, targets: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of every target class in the mask, in blocks; zero for others."""
        order, group, place, parts = self._by_group(targets.ravel(), np.ones(targets.size) if mask is None else mask)
        h = self._ordered(self.forward(keys)[-1].reshape(-1, self.width), order)
        layers = self._layers()
        logs = sum(self._exp(z, *each)[1] for z, *each in zip(self._sums(h, layers, parts), layers, (group, place), strict=True))
        out = np.zeros(targets.size, h.dtype)
        out[order] = logs
        return out.reshape(targets.shape)

    def scored(self, keys: np.ndarray, targets: np.ndarray, mask: np.ndarray, step: int = 2048) -> np.ndarray:
        """Log probabilities of the real targets, in order."""
        parts = [self.log_probability(*(part[k : k + step] for part in (keys, targets, mask))) for k in range(0, len(keys), step)]
        return np.concatenate(parts)[mask].astype(float) if parts else np.zeros(0)

    def _by_class(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of rows by their input class; those that pad have no slope.

        The first classes are the most frequent ones, and their rows are added up by products.
        """
        out = np.zeros((self.classes + 2, values.shape[1]), values.dtype)
        at = at.astype(np.int16 if len(out) < 1 << 15 else np.int64)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(np.bincount(at, minlength=len(out)))
        rows = self._taken("ordered", values, order[: ends[self.classes]])
        ones = np.ones(len(rows), values.dtype)
        often = min(self.GROUP, self.classes)
        for c, (a, b) in enumerate(zip([0, *ends[: often - 1]], ends[:often], strict=True)):
            out[c] = ones[a:b] @ rows[a:b]
        start, held = ends[often - 1], often + np.flatnonzero(np.diff(ends[often - 1 : self.classes + 1]))
        if len(held):
            out[held] = np.add.reduceat(rows[start:], ends[held - 1] - start, axis=0)
        return out

    def gradient(self, keys: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """Loss and its slope; ``weight`` counts each position (a mask, or numbers of copies)."""
        q, k, v, a, heads = self.forward(keys)
        p, inputs = self.p, keys[:, BLOCK:]
        order, group, place, parts = self._by_group(targets.ravel(), weight)
        real = weight.ravel().take(order)
        n, scale = max(float(real.sum()), 1.0), heads.dtype.type(self.width**-0.5)
        weight = (real / n).astype(heads.dtype)
        grad = np.zeros_like(self.params)
        g = self._views(grad)
        layers = self._layers()
        h, logs = self._ordered(heads.reshape(-1, self.width), order), 0.0
        sums = self._sums(h, layers, parts)
        for z, layer, at in zip(sums, layers, (group, place), strict=True):
            chosen, more, total = self._exp(z, layer, at)
            z *= (weight / total)[:, None]
            z.reshape(-1)[chosen] -= weight
            logs = logs + more
        z, inner = sums
        slope = h.T @ z
        g["out"][:], g["bias"][:] = slope[:-1], slope[-1]
        sorted_d = self._product("sorted_d", z, p["out"].T)
        for number, part in parts:
            slope = h[part].T @ inner[part]
            g["member"][number], g["place"][number] = slope[:-1], slope[-1]
            sorted_d[part] += inner[part] @ p["member"][number].T
        d = self._room("d", heads.dtype, targets.size, self.width)
        if len(order) < len(d):
            d[:] = 0
            d[order] = sorted_d
        else:
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            sorted_d.take(back, 0, out=d, mode="clip")
        d = d.reshape(heads.shape)
        d *= 1 - heads * heads
        da = self._product("da", d, v.transpose(0, 2, 1))
        da -= np.einsum("bij,bij->bi", da, a)[:, :, None]
        ds = np.multiply(da, a, out=da)
        g["near"][:] = np.bincount(self.distance.ravel(), ds.sum(axis=0).ravel(), 2 * BLOCK)
        for names, at, left, right in (
            (("query", "direct"), inputs, (ds, None), (k, d)),
            (("key", "value"), keys, (ds.transpose(0, 2, 1), a.transpose(0, 2, 1)), (q, d)),
        ):
            both = self._room("both", heads.dtype, *at.shape, 2, self.width)
            for side in range(2):
                if left[side] is None:
                    both[:, :, side] = right[side]
                else:
                    np.matmul(left[side], right[side], out=both[:, :, side])
            slopes = self._by_class(at.ravel(), both.reshape(-1, 2 * self.width))
            for name, part in zip(names, np.split(slopes, 2, axis=1), strict=True):
                g[name][:] = part
        g["query"] *= scale
        return -float((logs * real).sum()), grad


class Adam:
    def __init__(self, size: int, rate: float):
        self.rate, self.m, self.v, self.t = rate, np.zeros(size, np.float32), np.zeros(size, np.float32), 0

    def step(self, params: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        m, v = self.m / (1 - 0.9**self.t), self.v / (1 - 0.99**self.t)
        params -= self.rate * m / (np.sqrt(v) + 1e-6)
