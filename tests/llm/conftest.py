import pytest


@pytest.fixture(scope="session")
def roots():
    """Smallest node that links reach, of nodes and a test of two."""

    def of(nodes, linked):
        parent = {n: n for n in nodes}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        ordered = sorted(nodes)
        for k, a in enumerate(ordered):
            for b in ordered[k + 1 :]:
                if linked(a, b):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
        return {n: find(n) for n in nodes}

    return of
