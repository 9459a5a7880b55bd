"""Targets of sources by plain Python."""

from itertools import cycle


def targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight, left, done = dict(zip(order, cycle(weights))), set(order), {}
    while left:
        rest, total = sum(sizes.values()) - sum(done.values()), sum(weight[s] for s in left)
        over = {s for s in left if rest * weight[s] / total > most * sizes[s]}
        done |= {s: float(most * sizes[s]) if s in over else rest * weight[s] / total for s in (over or left)}
        left -= over or left
    return done
