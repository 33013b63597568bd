"""A gated recurrent language model in numpy, with a class-factored softmax.

Words are the corpus's most frequent ones; all others are one word, TAIL. The
output is factored: first the class of the next word, then the word in its
class, so that a step costs the classes and one class's words rather than the
vocabulary. Training is truncated backpropagation over windows of WINDOW steps;
the state goes on from window to window, in training and in scoring, so that a
document's log-likelihood is that of the whole document. Documents run one
after another in parallel streams: where one ends the next one of the queue
begins, with a fresh state, so that a long document holds nothing up.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np

HIDDEN, WINDOW, STREAMS = 24, 32, 128
RATE, CLIP = 0.1, 5.0
#: Ids of the end of a document (also what stands before its first word) and of words outside of the vocabulary.
END, TAIL = 0, 1


def class_bounds(counts: np.ndarray) -> np.ndarray:
    """First ids of classes of about equal mass by the square root of frequency; ids are in order of frequency from 2 on.

    END and TAIL are classes of their own; the rest are in as many classes as the root of their number.
    """
    classes = max(1, round(len(counts) ** 0.5))
    mass = np.sqrt(counts[2:].astype("f8"))
    share = np.cumsum(mass) / max(mass.sum(), 1e-9)
    cuts = 2 + np.searchsorted(share, np.arange(1, classes) / classes) + 1
    return np.unique(np.concatenate([[0, 1, 2], cuts[cuts < len(counts)], [len(counts)]])).astype(int)


def _rows(of: np.ndarray, at: np.ndarray, out: np.ndarray) -> np.ndarray:
    """of[at], in out; all of at are rows of it."""
    return np.take(of, at, 0, out=out, mode="clip")


def _order(ids: np.ndarray, most: int) -> np.ndarray:
    """A stable order of ids below most."""
    return np.argsort(ids.astype("u2") if most <= 1 << 16 else ids, kind="stable")


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def _with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights of an output for each row, the bias behind them."""
    return np.concatenate([weights, bias[:, None]], 1)


class Network:
    """Parameters and passes. counts[i] is the training count of id i; biases start at the counts' log shares."""

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, seed: int = 42):
        rng, self.hidden, self.bounds = np.random.default_rng(seed), hidden, class_bounds(counts)
        n, classes = len(counts), len(self.bounds) - 1
        self.of = np.repeat(np.arange(classes), np.diff(self.bounds)).astype("i2")
        #: Words that are alone in their class.
        self.single = self.bounds[:-1][np.diff(self.bounds) == 1]
        log = np.log(counts + 1.0)
        mass = np.array([np.logaddexp.reduce(log[a:b]) for a, b in zip(self.bounds, self.bounds[1:], strict=False)])
        normal = lambda *shape: rng.normal(0, 0.1, shape)
        self.p = {
            "x": normal(n, 3 * hidden), "r": normal(hidden, 3 * hidden), "b": np.zeros(3 * hidden),
            "wc": normal(hidden, classes), "bc": mass - np.logaddexp.reduce(mass), "u": normal(n, hidden), "bu": log - mass[self.of],
        }
        self.p = {k: v.astype("f4") for k, v in self.p.items()}
        self.seen = {k: np.full_like(v, 1e-2) for k, v in self.p.items()}
        self._kept: dict[tuple, np.ndarray] = {}

    def _space(self, name: str, *shape: int, kind=np.dtype("f4")) -> np.ndarray:
        """An array to be filled, in memory that is kept from window to window under its name."""
        size = math.prod(shape)
        if (kept := self._kept.get((name, kind))) is None or kept.size < size:
            kept = self._kept[name, kind] = np.empty(size, kind)
        return kept[:size].reshape(shape)

    # -- passes over one window: ids, targets and fresh are (steps, streams); states are (steps, hidden, streams), so that
    # -- each gate of a step lies in one piece

    def _recur(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool):
        """States behind each step, and with keep what the way back needs; a fresh stream's state is zero."""
        p, n, (steps, streams) = self.p, self.hidden, ids.shape
        # Gates are 1 / (1 + exp(-x)): their signs turn here, once.
        sign = np.repeat(np.array([-1, -1, 1], "f4"), n)
        inputs = self._space("inputs", steps, 3 * n, streams)
        inputs[...] = _rows((p["x"] + p["b"]) * sign, ids, self._space("rows", steps, streams, 3 * n)).transpose(0, 2, 1)
        r = np.ascontiguousarray((p["r"] * sign).T)
        states = self._space("states", steps, n, streams)
        before, gates, new, through = (self._space(x, steps if keep else 1, k, streams) for x, k in (("before", n), ("gates", 2 * n), ("new", n), ("through", 3 * n)))
        some = fresh.any(1).tolist()
        for t in range(steps):
            k = t if keep else 0
            if some[t]:
                h = np.where(fresh[t], np.float32(0), h)
            if keep:
                before[k] = h
            back = np.matmul(r, h, out=through[k])
            g, m, now = gates[k], new[k], states[t]
            np.add(inputs[t, : 2 * n], back[: 2 * n], out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.multiply(g[:n], back[2 * n :], out=m)
            m += inputs[t, 2 * n :]
            np.tanh(m, out=m)
            np.subtract(h, m, out=now)
            now *= g[n:]
            now += m
            h = now
        return states, h, (before, gates, new, through[:, 2 * n :])

    def _by_class(self, targets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """For classes of several words their first and last id and place among the targets, which are in order."""
        cuts = np.searchsorted(targets, self.bounds).tolist()
        bounds = self.bounds.tolist()
        return [(x, y, a, b) for x, y, a, b in zip(bounds, bounds[1:], cuts, cuts[1:], strict=False) if a < b and y - x > 1]

    def _outputs(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Weights and biases of classes and of words (none of a class's only word), and whether all logits of the states are small enough for a plain exp."""
        p = self.p
        classes, words = _with_bias(p["wc"].T, p["bc"]), _with_bias(p["u"], p["bu"])
        words[self.single] = 0
        most = np.float32(max(1.0, np.abs(states).max(initial=0)))
        return classes, words, bool(max(np.abs(classes).sum(1).max(), np.abs(words).sum(1).max()) * most < 60)

    def _by_token(self, states: np.ndarray) -> np.ndarray:
        """states as (steps, streams, hidden), in one piece."""
        steps, n, streams = states.shape
        out = self._space("by token", steps, streams, n)
        out[...] = states.transpose(0, 2, 1)
        return out

    def _and_one(self, states: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Rows of states in that order and a last column of ones, so that products add a bias."""
        out = self._space("and one", len(order), self.hidden + 1, kind=states.dtype)
        out[:, :-1], out[:, -1] = _rows(states, order, self._space("ordered", len(order), self.hidden, kind=states.dtype)), 1
        return out

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithms for rows of states and their next words."""
        order = _order(targets, len(self.of))
        targets = targets[order]
        rows = self._and_one(states, order)
        by_class, by_word, plain = self._outputs(states)

        def log_sums(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
            e = np.matmul(rows, weights.T, out=self._space("e", len(rows), len(weights), kind=rows.dtype))
            shift = 0 if plain else e.max(1)
            if not plain:
                e -= shift[:, None]
            np.exp(e, out=e)
            return np.log(e @ np.ones(len(weights), e.dtype)) + shift

        found = np.einsum("ij,ij->i", rows, by_class.take(self.of[targets], 0)) - log_sums(rows, by_class)
        own = np.einsum("ij,ij->i", rows, by_word.take(targets, 0))
        for first, last, a, b in self._by_class(targets):
            found[a:b] += own[a:b] - log_sums(rows[a:b], by_word[first:last])
        out = np.empty_like(found)
        out[order] = found
        return out

    def _output_gradients(self, states: np.ndarray, targets: np.ndarray, grads: dict) -> np.ndarray:
        order = _order(targets, len(self.of))
        targets = targets[order]
        rows, n = self._and_one(states, order), self.hidden
        by_class, by_word, plain = self._outputs(states)

        def pull(rows: np.ndarray, weights: np.ndarray, out: np.ndarray, grad: np.ndarray) -> None:
            """What the softmax's sum gives: mean weights for each row, and the rows by their shares for each output."""
            e = np.matmul(rows, weights.T, out=self._space("e", len(rows), len(weights), kind=rows.dtype))
            if not plain:
                e -= e.max(1)[:, None]
            np.exp(e, out=e)
            shares = 1 / (e @ np.ones(len(weights), e.dtype))
            e *= shares[:, None]
            np.matmul(e, weights[:, :n], out=out)
            np.matmul(e.T, rows, out=grad)

        def less(of: np.ndarray, grad: np.ndarray) -> None:
            """What the targets, which are in order, take away."""
            starts = _starts(of)
            grad[of[starts]] -= np.add.reduceat(rows, starts)

        for_classes, for_words = np.zeros_like(by_class), np.zeros_like(by_word)
        found, inner = (self._space(x, len(rows), n, kind=rows.dtype) for x in ("found", "inner"))
        inner[...] = 0
        if len(rows):
            of = self.of[targets]
            pull(rows, by_class, found, for_classes)
            for first, last, a, b in self._by_class(targets):
                pull(rows[a:b], by_word[first:last], inner[a:b], for_words[first:last])
            less(of, for_classes)
            less(targets, for_words)
            for_words[self.single] = 0
            found += inner
            found -= by_class.take(of, 0)[:, :n]
            found -= by_word.take(targets, 0)[:, :n]
        grads["wc"], grads["bc"] = np.ascontiguousarray(for_classes[:, :n].T), for_classes[:, n].copy()
        grads["u"], grads["bu"] = np.ascontiguousarray(for_words[:, :n]), for_words[:, n].copy()
        out = np.empty_like(found)
        out[order] = found
        return out

    def _learn(self, ids: np.ndarray, targets: np.ndarray, mask: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One step of Adagrad on a window; the state behind it."""
        p, n, (steps, streams) = self.p, self.hidden, ids.shape
        states, last, (before, gates, new, back) = self._recur(ids, fresh, h, True)
        grads: dict[str, np.ndarray] = {}
        by_token, out = self._by_token(states), self._space("out", steps, n, streams)
        if mask.all():
            by_token[...] = self._output_gradients(by_token.reshape(-1, n), targets.reshape(-1), grads).reshape(by_token.shape)
        else:
            pulled = self._output_gradients(by_token[mask], targets[mask], grads)
            by_token[...] = 0
            by_token[mask] = pulled
        out[...] = by_token.transpose(0, 2, 1)
        reset, update = gates[:, :n], gates[:, n:]
        # What a state's gradient is multiplied by on its way through the reset gate, to both gates, to the new state and to
        # the state before: known for all steps at once.
        ways, some = self._space("ways", steps, 5, n, streams), self._space("some", steps, n, streams)
        np.multiply(new, new, out=ways[:, 3])
        np.subtract(1, ways[:, 3], out=ways[:, 3])
        np.subtract(1, update, out=some)
        ways[:, 3] *= some
        np.subtract(before, new, out=ways[:, 2])
        ways[:, 2] *= update
        ways[:, 2] *= some
        np.multiply(ways[:, 3], reset, out=ways[:, 0])
        np.subtract(1, reset, out=some)
        some *= back
        np.multiply(ways[:, 0], some, out=ways[:, 1])
        ways[:, 4] = update
        r = np.concatenate([p["r"][:, 2 * n :], p["r"][:, : 2 * n]], 1)
        starting, after = fresh.any(1).tolist(), np.zeros((n, streams), "f4")
        for t in range(steps - 1, -1, -1):
            d, way = out[t], ways[t]
            d += after
            way *= d
            np.matmul(r, way[:3].reshape(3 * n, streams), out=after)
            after += way[4]
            if starting[t]:
                after[:, fresh[t]] = 0
        through = np.matmul(before, ways[:, :3].reshape(steps, 3 * n, streams).transpose(0, 2, 1)).sum(0)
        grads["r"] = np.concatenate([through[:, n:], through[:, :n]], 1)
        flat, words = self._space("flat", steps, streams, 3 * n), ids.reshape(-1)
        flat[...] = ways[:, 1:4].reshape(steps, 3 * n, streams).transpose(0, 2, 1)
        order = _order(words, len(p["x"]))
        starts = _starts(words[order])
        rows = words[order[starts]]
        grads["x"] = np.add.reduceat(_rows(flat.reshape(-1, 3 * n), order, self._space("rows", len(order), 3 * n)), starts)
        grads["b"] = grads["x"].sum(0)
        scale = 1 / max(1, streams)
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())) * scale
        scale *= min(1.0, CLIP / (norm + 1e-9))
        for k, g in grads.items():
            g *= np.float32(scale)
            if k == "x":
                seen = self.seen[k][rows] + g * g
                self.seen[k][rows] = seen
                p[k][rows] -= np.float32(RATE) * g / np.sqrt(seen)
            else:
                self.seen[k] += g * g
                p[k] -= np.float32(RATE) * g / np.sqrt(self.seen[k])
        return last

    # -- documents: arrays of ids that close with END --

    @staticmethod
    def _windows(docs: Iterable[np.ndarray], streams: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Window after window: ids, targets, the document (by its number) of each place or -1, fresh, and which of the last window's streams go on."""
        queue = enumerate(docs)
        running: list[tuple[int, np.ndarray, int] | None] = [None] * streams
        last = np.full(streams, END, "i4")
        while True:
            targets, owner = np.zeros((len(running), WINDOW), "i4"), np.full((len(running), WINDOW), -1, "i4")
            fresh = np.zeros((len(running), WINDOW), bool)
            on = []
            for s, now in enumerate(running):
                at = 0
                while at < WINDOW:
                    if now is None:
                        if (following := next(queue, None)) is None:
                            break
                        now = (*following, 0)
                    k, doc, place = now
                    n = min(WINDOW - at, len(doc) - place)
                    targets[s, at : at + n] = doc[place : place + n]
                    owner[s, at : at + n] = k
                    if not place:
                        fresh[s, at] = True
                    at += n
                    now = (k, doc, place + n) if place + n < len(doc) else None
                running[s] = now
                if at:
                    on.append(s)
            if not on:
                return
            ids = np.concatenate([last[:, None], targets[:, :-1]], 1)
            ids[fresh] = END
            if len(on) < len(running):
                running = [running[s] for s in on]
                ids, targets, owner, fresh = (x[on] for x in (ids, targets, owner, fresh))
            last = targets[:, -1]
            yield (*(np.ascontiguousarray(x.T) for x in (ids, targets, owner, fresh)), np.array(on))

    def train(self, docs: Iterable[np.ndarray], streams: int = STREAMS) -> None:
        """One pass over the documents, in their order."""
        h = np.zeros((self.hidden, streams), "f4")
        for ids, targets, owner, fresh, on in self._windows(docs, streams):
            h = self._learn(ids, targets, owner >= 0, fresh, h[:, on])

    def score(self, docs: list[np.ndarray], streams: int = 2 * STREAMS) -> np.ndarray:
        """Natural-log likelihood of each document, its end included."""
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))  # the longest start first, so that streams end together
        total = np.zeros(len(docs))
        h = np.zeros((self.hidden, streams), "f4")
        for ids, targets, owner, fresh, on in self._windows((docs[i] for i in order), streams):
            states, h, _ = self._recur(ids, fresh, h[:, on], False)
            mask, states = owner >= 0, self._by_token(states)
            if mask.all():
                total += np.bincount(owner.reshape(-1), self.log_probabilities(states.reshape(-1, self.hidden), targets.reshape(-1)), len(docs))
            else:
                total += np.bincount(owner[mask], self.log_probabilities(states[mask], targets[mask]), len(docs))
        out = np.empty(len(docs))
        out[order] = total
        return out

    def blob(self) -> bytes:
        return b"".join(v.tobytes() for v in self.p.values())

    def load(self, blob: bytes) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = np.frombuffer(blob, "f4", v.size, at).reshape(v.shape).copy()
            at += v.nbytes
