"""Points of the globe inside a task: counts within distances, and the nearest other one.

Points are sorted into blocks of neighbours; spheres around blocks tell which ones lie wholly within a distance or beyond it.
What is left is compared by squared chords, one product of matrices a block, and by the great circle where rounding could decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from fieldtrace.functions.geo import EARTH_RADIUS_M

#: Points of a block, and blocks that meet one at once.
BLOCK, _AT_ONCE = 64, 12
_EPS = 4e-15


class Points:
    """Latitudes and longitudes in radians; chords are those of the unit sphere, around the mean so that little is lost to rounding."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray):
        self.lat, self.lon, self.cos = lat, lon, np.cos(lat)
        at = np.stack([self.cos * np.cos(lon), self.cos * np.sin(lon), np.sin(lat)])
        self.at = at - at.mean(1, keepdims=True)
        self.square = (self.at**2).sum(0)
        self.loss = 4 * _EPS * self.square.max(initial=0.0)

    def metres(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """``haversine_m`` of points ``i`` and ``j``."""
        dp, dl = np.sin((self.lat[j] - self.lat[i]) / 2), np.sin((self.lon[j] - self.lon[i]) / 2)
        a = np.clip(dp * dp + self.cos[i] * self.cos[j] * (dl * dl), 0.0, 1.0)
        return 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(1.0 - a))

    def blocks(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of places in blocks (the last one filled up with its last place), how many each has, and the spheres around them."""
        n = len(of)
        order = np.argsort(self.lat[of], kind="stable")
        strip = BLOCK * max(int(np.sqrt(n / BLOCK)), 1)
        of = of[order[np.lexsort((self.lon[of[order]], np.arange(n) // strip))]]
        rows = of[np.minimum(np.arange(-(-n // BLOCK) * BLOCK), n - 1)].reshape(-1, BLOCK)
        size = np.full(len(rows), BLOCK)
        size[-1] = n - BLOCK * (len(rows) - 1)
        inside = self.at[:, rows]
        middle = (inside.min(2) + inside.max(2)) / 2
        return rows, size, middle, np.sqrt(((inside - middle[:, :, None]) ** 2).sum(0).max(1))

    def _meetings(self, own: np.ndarray) -> Iterator[tuple]:
        """Each block of ``own`` with the least and the greatest chord to every block of all points."""
        every = self.blocks(np.arange(len(self.lat)))
        rows, size, middle, radius = self.blocks(own)
        slack = 1e-15 + np.sqrt(self.loss) * 1e-3
        for k in range(len(rows)):
            d = np.sqrt(((every[2] - middle[:, k : k + 1]) ** 2).sum(0))
            reach = (every[3] + radius[k]) * (1 + 1e-12) + slack
            yield rows[k, : size[k]], every[0], every[1], np.maximum(d - reach, 0.0), d + reach

    def _chords(self, own: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Squared chords, a row for each of ``others``."""
        a = np.stack([*self.at[:, others], self.square[others], np.ones(len(others))], 1)
        return a @ np.stack([*(-2 * self.at[:, own]), np.ones(len(own)), self.square[own]])

    def _tiles(self, rows: np.ndarray, size: np.ndarray, which: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(0, len(which), _AT_ONCE):
            some = which[k : k + _AT_ONCE]
            yield rows[some][np.arange(BLOCK) < size[some][:, None]]

    def within(self, own: np.ndarray, thresholds_m: tuple[float, ...]) -> np.ndarray:
        """For points ``own`` (places, each once): how many other points are within each distance."""
        found = np.zeros((len(thresholds_m), len(self.lat)), np.int64)
        chords = [2 * np.sin(min(t / (2 * EARTH_RADIUS_M), np.pi / 2)) for t in thresholds_m]
        for mine, rows, size, least, most in self._meetings(own):
            for k, (t, chord) in enumerate(zip(thresholds_m, chords, strict=True)):
                edge = self.loss + _EPS * chord
                inner = most < chord * (1 - 1e-12) if chord < 2 else np.zeros(len(most), bool)
                found[k, mine] += size[inner].sum()
                for others in self._tiles(rows, size, np.flatnonzero(~inner & (least <= chord * (1 + 1e-12) + edge))):
                    d = self._chords(mine, others)
                    near = d <= chord * chord - edge
                    found[k, mine] += near.view(np.uint8).sum(0, dtype=np.uint16)
                    unsure = (d <= chord * chord + edge) & ~near if chord * chord > edge else d <= chord * chord + edge
                    if unsure.any():
                        j, i = np.nonzero(unsure)
                        np.add.at(found[k], mine[i], self.metres(mine[i], others[j]) <= t)
        return found[:, own] - 1  # a point is 0 m from itself

    def nearest(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For points ``own`` the place of the nearest other one and its distance; -1 and infinity if there is no other.

        Of equally near ones the next one in order counts, then the first before; places are the order.
        """
        place, metres = np.full(len(self.lat), -1), np.full(len(self.lat), np.inf)
        for mine, rows, size, least, most in self._meetings(own):
            bound = most[size > 1].min(initial=np.inf) if len(self.lat) > BLOCK else np.inf
            i_, j_, d_ = [], [], []
            for others in self._tiles(rows, size, np.flatnonzero(least <= bound)):
                d = self._chords(mine, others)
                d[others[:, None] == mine] = np.inf
                low = d.min(0)
                j, i = np.nonzero((d <= low + 2 * (self.loss + _EPS * np.sqrt(np.abs(low)))) & np.isfinite(d))
                i, j = mine[i], others[j]
                far = self.metres(i, j)
                first = np.lexsort((j, j < i, far, i))
                first = first[np.append(True, i[first][1:] != i[first][:-1])[: len(first)]]
                for held, new in zip((i_, j_, d_), (i, j, far), strict=True):
                    held.append(new[first])
            i, j, far = (np.concatenate(held) if held else np.zeros(0, int) for held in (i_, j_, d_))
            first = np.lexsort((j, j < i, far, i))
            first = first[np.append(True, i[first][1:] != i[first][:-1])[: len(first)]]
            place[i[first]], metres[i[first]] = j[first], far[first]
        return place[own], metres[own]
