"""A linear-chain conditional random field over sets of string features."""

from __future__ import annotations

import math
import random

LABELS = ("O", "K", "S")  # other, announces a secret, secret
N = len(LABELS)
R = range(N)


class Crf:
    def __init__(self) -> None:
        self.weights: dict[str, list[float]] = {}
        self.moves = [[0.0] * N for _ in R]

    def emit(self, features: list[list[str]]) -> list[list[float]]:
        get, out = self.weights.get, []
        for fs in features:
            a = b = c = 0.0
            for f in fs:
                w = get(f)
                if w is not None:
                    a += w[0]
                    b += w[1]
                    c += w[2]
            out.append([a, b, c])
        return out

    def viterbi(self, features: list[list[str]]) -> list[int]:
        """Most probable labels of a sequence."""
        return self.best(self.emit(features))

    def best(self, emit: list[list[float]]) -> list[int]:
        """Most probable labels for given emissions."""
        moves = self.moves
        if not emit:
            return []
        score, back = emit[0], []
        for e in emit[1:]:
            row, new = [], []
            for y in R:
                best = max(R, key=lambda x: score[x] + moves[x][y])
                row.append(best)
                new.append(score[best] + moves[best][y] + e[y])
            back.append(row)
            score = new
        y = max(R, key=lambda x: score[x])
        path = [y]
        for row in reversed(back):
            y = row[y]
            path.append(y)
        return path[::-1]

    def _marginals(self, emit: list[list[float]]) -> tuple[list[list[float]], list[list[float]]]:
        """Label marginals, and expected moves summed over the sequence."""
        n, moves = len(emit), self.moves
        lse = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
        alpha, beta = [emit[0]], [[0.0] * N]
        for t in range(1, n):
            alpha.append([emit[t][y] + lse([alpha[-1][x] + moves[x][y] for x in R]) for y in R])
        for t in range(n - 1, 0, -1):
            beta.append([lse([moves[x][y] + emit[t][y] + beta[-1][y] for y in R]) for x in R])
        beta.reverse()
        z = lse(alpha[-1])
        node = [[math.exp(alpha[t][y] + beta[t][y] - z) for y in R] for t in range(n)]
        edge = [[0.0] * N for _ in R]
        for t in range(1, n):
            for x in R:
                for y in R:
                    edge[x][y] += math.exp(alpha[t - 1][x] + moves[x][y] + emit[t][y] + beta[t][y] - z)
        return node, edge

    def fit(self, data: list[tuple[list[list[str]], list[int]]], epochs: int = 4, rate: float = 0.3, l2: float = 1e-4, seed: int = 1) -> Crf:
        """Maximum likelihood by stochastic gradient with adaptive steps; the same data give the same weights."""
        squares: dict[str, list[float]] = {}
        move_squares = [[1e-3] * N for _ in R]
        order, rng = list(range(len(data))), random.Random(seed)
        for _ in range(epochs):
            rng.shuffle(order)
            for k in order:
                features, labels = data[k]
                if not features:
                    continue
                node, edge = self._marginals(self.emit(features))
                for x, y in zip(labels, labels[1:]):
                    edge[x][y] -= 1
                for t, fs in enumerate(features):
                    g = node[t]
                    g[labels[t]] -= 1
                    if max(map(abs, g)) < 1e-3:
                        continue
                    for f in fs:
                        w = self.weights.setdefault(f, [0.0] * N)
                        s = squares.setdefault(f, [1e-3] * N)
                        for y in R:
                            d = g[y] + l2 * w[y]
                            s[y] += d * d
                            w[y] -= rate * d / math.sqrt(s[y])
                for x in R:
                    for y in R:
                        d = edge[x][y] + l2 * self.moves[x][y]
                        move_squares[x][y] += d * d
                        self.moves[x][y] -= rate * d / math.sqrt(move_squares[x][y])
        return self
