"""The 64-bit linear congruential generator that picks BFS sources."""

from __future__ import annotations

# Multiplier and increment, modulo 2 ** 64.
MULTIPLIER, INCREMENT = 6364136223846793005, 1
MASK = (1 << 64) - 1


class LCG:
    """State after `step` draws from state 1; each call draws the next."""

    def __init__(self, step: int = 0):
        a, c, x = MULTIPLIER, INCREMENT, 1
        while step:  # the map x -> a x + c, composed by squaring
            if step & 1:
                x = (a * x + c) & MASK
            a, c, step = a * a & MASK, (a + 1) * c & MASK, step >> 1
        self.state = x

    def __call__(self) -> int:
        self.state = (MULTIPLIER * self.state + INCREMENT) & MASK
        return self.state


def pick_random_vertex(graph, rng: LCG) -> int:
    """The first draw modulo num_vertices that is a vertex with neighbours."""
    if not graph.num_edges:
        raise ValueError("no vertex has a neighbour")
    while True:
        tries = [rng() % graph.num_vertices]
        if graph.degrees.filter(graph.degrees["id"] == tries[0]).filter("degree > 0").limit(1).count():
            return tries[0]
