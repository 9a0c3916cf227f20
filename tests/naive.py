"""Brute-force definitions, one scenario at a time."""

import itertools

import numpy as np

from scenaria.model import Model


def scenarios(model):
    for reverse in itertools.product(*(range(n) for n in reversed(model.sizes))):
        yield tuple(reversed(reverse))


def blocks(model, u):
    b = [0] * model.dimensions
    for o, x in zip(model.offsets, u):
        for c in range(model.dimensions):
            b[c] += int(model.matrix[o + x][c])
    return [b[o : o + n] for o, n in zip(model.offsets, model.sizes)]


def move(block, own, margin=0):
    best = max(range(len(block)), key=lambda v: (block[v], -v))
    return best if block[best] > block[own] + margin else own


def step(model, u, margin=0):
    return tuple(move(b, x, margin) for b, x in zip(blocks(model, u), u))


def sequential(model, u):
    u = list(u)
    for k in range(len(u)):
        u[k] = move(blocks(model, u)[k], u[k])
    return tuple(u)


def kernel(model, f=step):
    return [u for u in scenarios(model) if f(model, u) == u]


def end(model, u, f=step):
    """(is a fixed point, attractor named by its least signature)."""
    seen = []
    while u not in seen:
        seen.append(u)
        u = f(model, u)
    ring = seen[seen.index(u) :]
    return len(ring) == 1, min(ring, key=lambda s: s[::-1])


def basins(model, f=step):
    sizes, cycles = {u: 0 for u in kernel(model, f)}, 0
    for u in scenarios(model):
        still, at = end(model, u, f)
        if still:
            sizes[at] += 1
        else:
            cycles += 1
    return sizes, cycles


def random_model(seed, low=-3, high=3, own=False, most=600):
    draw = np.random.default_rng(seed)
    while True:
        sizes = tuple(int(x) for x in draw.integers(1, 5, draw.integers(2, 6)))
        if np.prod(sizes) <= most:
            break
    n = sum(sizes)
    m = draw.integers(low, high + 1, (n, n))
    model = Model.build(sizes, m)
    if not own:
        m = m.copy()
        for o, k in zip(model.offsets, sizes):
            m[o : o + k, o : o + k] = 0
        model = Model.build(sizes, m)
    return model
