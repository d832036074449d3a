"""Dynamic time warping on batches of pairs, in numpy.

Rows of a batch are independent, and arrays are laid out (time, batch). Of the warping matrix two rows are kept, and of
those the band: a cell's place is its distance from the band's left edge, so with a radius r a row has 2 r + 1 cells
whatever the length, and time is linear in it. The cells' costs and the smaller of the two cells above are made for a
whole row at once; just the step from the left goes cell by cell. Batches are cut by what their buffers take.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BATCH = 4096  # pairs of a batch, at most
BUFFER = 16 << 20  # bytes of a batch's buffers, about
PATCH, PATCH_COLUMNS = 8192, 512  # pairs that a table of distances makes at once, and columns of those
MOVES = 64 << 20  # bytes of the moves that a batch of paths keeps, about
NARROW = 4  # radius up to which all cells of a band cost less than the bounds and indices that spare some
INF = np.inf


def _row(i: int, m: int, radius: int | None) -> tuple[int, int]:
    return (0, m) if radius is None else (max(0, i - radius), min(m, i + radius + 1))


def band(n: int, m: int, radius: int | None) -> tuple[int, int]:
    """(radius, width): a band that is wider than the matrix is all of it."""
    radius = max(n, m) if radius is None else min(radius, max(n, m))
    return radius, min(m, 2 * radius + 1)


def batch_size(n: int, m: int, radius: int | None) -> int:
    return max(1, min(BATCH, BUFFER // (8 * (n + m + 5 * (band(n, m, radius)[1] + 2)))))


def path_batch(n: int, m: int, radius: int | None) -> int:
    """Pairs whose moves, a byte for each cell of the band, fit into MOVES."""
    return max(1, min(batch_size(n, m, radius), MOVES // (n * band(n, m, radius)[1])))


def dtw(a: np.ndarray, b: np.ndarray, radius: int | None, cutoff: np.ndarray | None = None) -> np.ndarray:
    """Distances of the rows of a (B, n) and b (B, m): root of the least sum of squared differences along a
    path of steps down, right and diagonal. With cutoff (B,), infinite where the distance is above it; rows
    whose best cell is above it are dropped early."""
    out = np.empty(len(a))
    step = batch_size(a.shape[1], b.shape[1], radius)
    for at in range(0, len(a), step):
        s = slice(at, at + step)
        out[s] = _dtw(a[s], b[s], radius, None if cutoff is None else cutoff[s])
    return out


class _Band:
    """Two rows of the matrix. Cell j of a row that begins at column lo is held at j - lo + 1; the places around
    are infinite."""

    def __init__(self, width: int, size: int | tuple[int, int], kind: type = np.float64):
        self.shape = size = size if isinstance(size, tuple) else (size,)
        self.before, self.now = np.full((width + 2, *size), INF, kind), np.full((width + 2, *size), INF, kind)
        self.best, self.cost = np.empty((width, *size), kind), np.empty((width, *size), kind)
        self.lo, self.hi = 0, 0  # of the row before

    def first(self, a: np.ndarray, b: np.ndarray, hi: int) -> None:
        """The top row: all steps come from the left."""
        cost = self.cost[:hi]
        np.subtract(a[0], b[:hi], out=cost)
        np.multiply(cost, cost, out=cost)
        np.cumsum(cost, axis=0, out=self.before[1 : hi + 1])
        self.lo, self.hi = 0, hi

    def above(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(diagonal, above): the cells of the row before that end in columns lo..hi - 1, one to the left and straight."""
        at = lo - self.lo
        return self.before[at : at + hi - lo], self.before[at + 1 : at + 1 + hi - lo]

    def turn(self, lo: int, hi: int) -> None:
        self.now[0] = INF
        self.now[hi - lo + 1 :] = INF
        self.before, self.now, self.lo, self.hi = self.now, self.before, lo, hi

    def keep(self, rows: np.ndarray) -> None:
        self.before = np.ascontiguousarray(self.before[:, rows])
        size = self.before.shape[1]
        self.now, self.best, self.cost = np.full((len(self.now), size), INF), np.empty((len(self.best), size)), np.empty((len(self.cost), size))


def _dtw(a, b, radius, cutoff):
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    n, m, size = len(a), len(b), a.shape[1]
    radius, width = band(n, m, radius)
    limit = None if cutoff is None else np.where(cutoff < 0, -1.0, cutoff * cutoff)
    alive = np.arange(size)
    out = np.full(size, INF)
    rows = _Band(width, size)
    rows.first(a, b, _row(0, m, radius)[1])
    for i in range(n):
        lo, hi = _row(i, m, radius)
        if hi <= lo:  # the band has left the matrix
            return out
        if i:
            diagonal, above = rows.above(lo, hi)
            best, cost, now = rows.best[: hi - lo], rows.cost[: hi - lo], rows.now
            np.minimum(diagonal, above, out=best)
            np.subtract(a[i], b[lo:hi], out=cost)
            np.multiply(cost, cost, out=cost)
            now[0] = INF
            for k in range(hi - lo):
                np.minimum(best[k], now[k], out=best[k])
                np.add(best[k], cost[k], out=now[k + 1])
            rows.turn(lo, hi)
        if limit is not None and i < n - 1:
            keep = rows.before[1 : hi - lo + 1].min(axis=0) <= limit
            if keep.sum() < len(keep) / 2:
                a, b, limit, alive = np.ascontiguousarray(a[:, keep]), np.ascontiguousarray(b[:, keep]), limit[keep], alive[keep]
                rows.keep(keep)
                if not len(alive):
                    return out
    total = rows.before[m - rows.lo] if rows.hi == m else np.full(len(alive), INF)
    if limit is not None:
        total = np.where(total > limit, INF, total)
    out[alive] = np.sqrt(total)
    return out


def table(x: np.ndarray, y: np.ndarray | None, radius: int | None, kind: type = np.float64) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(rows, columns, distances) of patches that cover the table of all rows of x against all rows of y, bit for bit those of
    dtw(). Without y it is x against itself, and patches cover the part below the diagonal; what of them lies on or
    above it is 0. Series are turned once and pairs are not written out one by one, and as many pairs share a call as
    buffers in the cache hold. kind: the numbers to reckon with; table_error() bounds what float32 errs."""
    below = y is None
    x = x.astype(kind, copy=False)
    y = x if below else y.astype(kind, copy=False)
    n, m = x.shape[1], y.shape[1]
    radius, width = band(n, m, radius)
    narrow = n == m and radius <= NARROW and np.isfinite(x).all() and np.isfinite(y).all()
    size = 4 * PATCH if narrow else max(1, min(PATCH, BUFFER // (8 * 4 * (width + 2))))  # diagonals have fewer calls to spread, on longer rows
    across = max(1, min(len(y), 2 * PATCH_COLUMNS if narrow else PATCH_COLUMNS, size))
    x_t, y_t = np.ascontiguousarray(x.T), y.T
    if narrow:  # infinite beyond the ends; of unlike signs, as their difference must not be undefined
        x_t, y_t = (np.pad(v, ((radius, radius), (0, 0)), constant_values=rest) for v, rest in ((x_t, INF), (y_t[::-1], -INF)))
    rows = None
    for left in range(0, len(y), across):
        y_part = np.ascontiguousarray(y_t[:, left : left + across])[:, None, :]
        columns = slice(left, left + y_part.shape[2])
        step = max(1, size // y_part.shape[2])
        for top in range(left if below else 0, len(x), step):
            part = x_t[:, top : top + step, None]
            shape = (part.shape[1], y_part.shape[2])
            if rows is None or rows.shape != shape:
                rows = _Diagonals(radius, shape, kind) if narrow else _Band(width, shape, kind)
            found = np.sqrt(rows.last_cell(part, y_part) if narrow else _last_cell(part, y_part, radius, rows))
            if below and top < columns.stop:
                found = np.tril(found, top - left - 1)
            yield slice(top, top + shape[0]), columns, found


def table_error(n: int, m: int) -> float:
    """What part of itself a distance of table() in float32 may err, of series that are float32 and below 1e15. Costs are
    rounded three times, and a path's sum once for each of its n + m - 1 steps at most; all are positive, and the root halves
    the error. Twice that is given, so what sums of distances in double precision lose is within it."""
    return (n + m + 3) * 2.0**-24


class _Diagonals:
    """The band's cells on two neighbouring diagonals i + j, made over and over in place: three calls a diagonal for all its
    cells, where a row of the matrix goes cell by cell. Cells of a diagonal are two columns apart, those of the one before
    lie between, and the places around are infinite. Sums are those of _Band, bit for bit."""

    def __init__(self, radius: int, shape: tuple[int, int], kind: type):
        self.radius, self.shape = radius, shape
        self.cells = 2 * (radius // 2) + 1, 2 * ((radius + 1) // 2)  # of even and odd diagonals
        self.held = [np.empty((c + 2, *shape), kind) for c in self.cells]
        self.rest = np.empty((radius + 1, *shape), kind)

    def last_cell(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The matrix's last cell for each pair of a (n + 2 radius, rows, 1) and b (n + 2 radius, 1, columns), which is turned
        back to front; both have radius infinite places at each end."""
        radius, n = self.radius, len(a) - 2 * self.radius
        for h in self.held:
            h.fill(INF)
        self.held[0][1 + radius // 2] = 0  # before the first cell
        sides = []
        for p, c in enumerate(self.cells):
            o = self.held[1 - p]
            sides.append((c, self.held[p][1 : 1 + c], *((o[:-1], o[1:]) if c == radius + 1 else (o[1:-2], o[2:-1])), self.rest[:c]))
        for s in range(2 * n - 1):
            c, now, left, above, rest = sides[s & 1]
            if not c:
                continue
            i, j = (s - c + 1) // 2 + radius, n - 1 - (s + c - 1) // 2 + radius
            np.minimum(left, above, out=rest)
            np.minimum(now, rest, out=now)
            np.subtract(a[i : i + c], b[j : j + c], out=rest)
            np.multiply(rest, rest, out=rest)
            np.add(now, rest, out=now)
        return self.held[0][1 + radius // 2]


def _last_cell(a: np.ndarray, b: np.ndarray, radius: int, rows: _Band) -> np.ndarray:
    """The matrix's last cell for each pair of a (n, rows, 1) and b (m, 1, columns)."""
    n, m = len(a), len(b)
    rows.first(a, b, _row(0, m, radius)[1])
    rows.before[rows.hi + 1 :] = INF  # buffers are used again
    for i in range(1, n):
        lo, hi = _row(i, m, radius)
        if hi <= lo:  # the band has left the matrix
            return np.full(rows.cost.shape[1:], INF)
        diagonal, above = rows.above(lo, hi)
        best, cost, now = rows.best[: hi - lo], rows.cost[: hi - lo], rows.now
        np.minimum(diagonal, above, out=best)
        np.subtract(a[i], b[lo:hi], out=cost)
        np.multiply(cost, cost, out=cost)
        np.add(best[0], cost[0], out=now[1])
        for k in range(1, hi - lo):
            np.minimum(best[k], now[k], out=best[k])
            np.add(best[k], cost[k], out=now[k + 1])
        rows.turn(lo, hi)
    return rows.before[m - rows.lo] if rows.hi == m else np.full(rows.cost.shape[1:], INF)


def _steps_back(a: np.ndarray, b: np.ndarray, radius: int | None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Distances, and the steps of all pairs' paths from their ends on: (row, i, j) of each step back."""
    a_t, b_t = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    n, m, size = len(a_t), len(b_t), a_t.shape[1]
    radius, width = band(n, m, radius)
    move = np.zeros((n, width, size), np.uint8)  # of the band's cells: 0 diagonal, 1 above, 2 left
    rows = _Band(width, size)
    rows.first(a_t, b_t, _row(0, m, radius)[1])
    move[0] = 2
    for i in range(1, n):
        lo, hi = _row(i, m, radius)
        diagonal, above = rows.above(lo, hi)
        best, cost, now = rows.best[: hi - lo], rows.cost[: hi - lo], rows.now
        np.minimum(diagonal, above, out=best)
        np.subtract(a_t[i], b_t[lo:hi], out=cost)
        np.multiply(cost, cost, out=cost)
        np.copyto(move[i, : hi - lo], above < diagonal)
        now[0] = INF
        for k in range(hi - lo):
            np.maximum(move[i, k], (now[k] < best[k]).view(np.uint8) << 1, out=move[i, k])
            np.minimum(best[k], now[k], out=best[k])
            np.add(best[k], cost[k], out=now[k + 1])
        rows.turn(lo, hi)
    distance = np.sqrt(rows.before[m - rows.lo])
    row, i, j = np.arange(size), np.full(size, n - 1), np.full(size, m - 1)
    found = []
    while len(row):
        found.append((row, i, j))
        go = (i > 0) | (j > 0)
        if not go.all():
            row, i, j = row[go], i[go], j[go]
        step = np.where(i == 0, 2, np.where(j == 0, 1, move[i, j - np.maximum(0, i - radius), row]))
        i, j = i - (step != 2), j - (step != 1)
    return distance, found


def paths(a: np.ndarray, b: np.ndarray, radius: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distance, row, i, j): the steps of all pairs from (0, 0) on, ordered by row and step. Where several
    predecessors are equal the diagonal goes before the one above, and that before the left one. Keeps a byte for each
    cell of the band (see path_batch())."""
    distance, found = _steps_back(a, b, radius)
    rows, i, j = (np.concatenate(x)[::-1] for x in zip(*found))
    order = np.argsort(rows, kind="stable")
    return distance, rows[order], i[order], j[order]


def path_of(a: np.ndarray, b: np.ndarray, radius: int | None) -> list[tuple[int, int]]:
    """paths() of one pair, cell by cell: for a single pair plain numbers are faster than arrays of one."""
    x, y = a.tolist(), b.tolist()
    n, m = len(x), len(y)
    radius, _ = band(n, m, radius)
    before, from_, moves = [], 0, []  # of the row before: its cells and the column where they begin
    for i, u in enumerate(x):
        lo, hi = _row(i, m, radius)
        now, move, left = [], bytearray(hi - lo), INF
        end = from_ + len(before)
        for j in range(lo, hi):
            diagonal = before[j - 1 - from_] if from_ < j <= end else (0.0 if i == j == 0 else INF)
            above = before[j - from_] if from_ <= j < end else INF
            best, way = (above, 1) if above < diagonal else (diagonal, 0)
            if left < best:
                best, way = left, 2
            cost = u - y[j]
            left = best + cost * cost
            now.append(left)
            move[j - lo] = way
        before, from_ = now, lo
        moves.append((lo, move))
    i, j, out = n - 1, m - 1, [(n - 1, m - 1)]
    while i or j:
        way = 2 if i == 0 else 1 if j == 0 else moves[i][1][j - moves[i][0]]
        i, j = i - (way != 2), j - (way != 1)
        out.append((i, j))
    return out[::-1]


def _window(x: np.ndarray, radius: int, of: np.ufunc, rest: float) -> np.ndarray:
    """The ufunc over 2 radius + 1 neighbours: blocks of that width, running from their left and from their right, so a
    place costs the same whatever the radius. A few neighbours are looked at one by one."""
    count, n = x.shape
    width = 2 * radius + 1
    if radius <= NARROW:
        out = x.copy()
        for s in range(1, min(radius, n - 1) + 1):
            of(out[:, s:], x[:, :-s], out=out[:, s:])
            of(out[:, :-s], x[:, s:], out=out[:, :-s])
        return out
    blocks = -(-(n + 2 * radius) // width)
    padded = np.full((count, blocks * width), rest)
    padded[:, radius : radius + n] = x
    cut = padded.reshape(count, blocks, width)
    left = of.accumulate(cut, axis=2).reshape(padded.shape)
    right = of.accumulate(cut[:, :, ::-1], axis=2)[:, :, ::-1].reshape(padded.shape)
    return of(right[:, :n], left[:, width - 1 : width - 1 + n])


def envelopes(x: np.ndarray, radius: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(upper, lower) of each row."""
    n = x.shape[1]
    if radius is None or radius >= n:
        return np.repeat(x.max(axis=1, keepdims=True), n, 1), np.repeat(x.min(axis=1, keepdims=True), n, 1)
    return _window(x, radius, np.maximum, -INF), _window(x, radius, np.minimum, INF)


def lb_keogh(q: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    gap = np.maximum(np.maximum(q - upper, lower - q), 0)
    return np.sqrt((gap * gap).sum(axis=-1))


def lb_two_pass(q: np.ndarray, c: np.ndarray, upper: np.ndarray, lower: np.ndarray, radius: int | None) -> np.ndarray:
    """Lemire's bound of rows q against one series c, or a row of c each, with its envelope; never above the distance."""
    clipped_upper, clipped_lower = envelopes(np.clip(q, lower, upper), radius)
    return np.hypot(lb_keogh(q, upper, lower), lb_keogh(c, clipped_upper, clipped_lower))


#: What settled a pair of cascade(): each of both bounds, the distance beyond the cutoff, or within it.
SETTLED = ("keogh", "two_pass", "cutoff", "distance")


def cascade(a: np.ndarray, b: np.ndarray, radius: int | None, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, which of SETTLED) of rows a and b with their cutoffs: infinite if a bound reaches the cutoff, and only
    what both bounds let pass is warped. Bounds hold for equal lengths; other pairs are all warped."""
    out, by = np.full(len(a), INF), np.zeros(len(a), np.int8)
    at = np.arange(len(a))
    if a.shape[1] == b.shape[1]:
        upper, lower = envelopes(b, radius)
        at = np.flatnonzero(lb_keogh(a, upper, lower) < cutoff)
        by[at] = 1
        at = at[lb_two_pass(a[at], b[at], upper[at], lower[at], radius) < cutoff[at]]
    out[at] = dtw(a[at], b[at], radius, cutoff[at])
    by[at] = np.where(np.isfinite(out[at]), 3, 2)
    return out, by


def nearest(x: np.ndarray, centroids: np.ndarray, radius: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, distance) of each row, exact; of ties the least centroid. Bounds that a centroid cannot
    beat the best so far spare its distance. In a narrow band bounds cost more than they spare, and a patch of rows takes
    all distances at once."""
    best, label = np.full(len(x), INF), np.zeros(len(x), np.int64)
    k, n = centroids.shape
    if n == x.shape[1] and band(n, n, radius)[0] <= NARROW:
        radius, width = band(n, n, radius)
        turned, step = np.ascontiguousarray(centroids.T)[:, :, None], max(1, PATCH // k)
        for at in range(0, len(x), step):
            part = np.ascontiguousarray(x[at : at + step].T)[:, None, :]
            d = np.sqrt(_last_cell(turned, part, radius, _Band(width, (k, part.shape[2]))))
            d[np.isnan(d)] = INF
            label[at : at + step] = d.argmin(axis=0)
            best[at : at + step] = d.min(axis=0)
        return label, best
    for c, centroid in enumerate(centroids):
        up, low = (e[0] for e in envelopes(centroid[None, :], radius))
        at = np.flatnonzero(lb_keogh(x, up, low) < best)
        if len(at) and np.isfinite(best[at]).any():
            at = at[lb_two_pass(x[at], centroid, up, low, radius) < best[at]]
        if not len(at):
            continue
        d = dtw(x[at], np.broadcast_to(centroid, (len(at), len(centroid))), radius, best[at])
        won = d < best[at]
        best[at[won]], label[at[won]] = d[won], c
    return label, best


def bound_moves(before: np.ndarray, now: np.ndarray, radius: int | None) -> np.ndarray:
    """How much the distance of any series to each centroid can have changed as the centroids moved. Along the best path
    to the one centroid, the other costs as much more as the root of the sum of squared moves over the path's steps;
    a band of radius r lets 2 r + 1 steps share a place. (The triangle inequality doesn't hold under warping.) What
    rounding may add is added."""
    n = now.shape[1]
    width = n if radius is None else min(n, 2 * radius + 1)
    moved = np.sqrt(width * ((now - before) ** 2).sum(axis=1))
    return moved * (1 + 1e-9) + 1e-9


def nearest_bounded(x: np.ndarray, centroids: np.ndarray, radius: int | None, label: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
    """(centroid, distance, lower bounds, warped, spared) of each row, the first two as of nearest(): the distance to the last
    label's centroid is made first, and kept lower bounds (B, k) that are above it spare the others. Where they don't,
    Keogh's and Lemire's bounds are tried, and what they let pass is warped. The bounds that come back are distances, where
    those were made, or the best of all bounds."""
    rows, k = len(x), len(centroids)
    label, lower = label.astype(np.int64), lower.copy()
    best = np.empty(rows)
    for c in np.unique(label):
        at = np.flatnonzero(label == c)
        best[at] = dtw(x[at], np.broadcast_to(centroids[c], (len(at), x.shape[1])), radius)
    first, every = label.copy(), np.arange(rows)
    lower[every, first] = best
    warped, spared = np.ones(rows, np.int32), np.zeros(rows, np.int32)
    sure = lambda bound: bound * (1 - 1e-9) - 1e-9  # noqa: E731  what rounding may have added is taken off

    for c in range(k):
        other = first != c
        open_ = lambda at: at[(lower[at, c] < best[at]) | ((lower[at, c] == best[at]) & (c < label[at]))]  # noqa: B023, E731
        at = open_(np.flatnonzero(other))
        spared += other
        spared[at] -= 1
        if not len(at):
            continue
        up, low = (e[0] for e in envelopes(centroids[c][None, :], radius))
        lower[at, c] = np.maximum(lower[at, c], sure(lb_keogh(x[at], up, low)))
        at = open_(at)
        lower[at, c] = np.maximum(lower[at, c], sure(lb_two_pass(x[at], centroids[c], up, low, radius)))
        at = open_(at)
        d = dtw(x[at], np.broadcast_to(centroids[c], (len(at), x.shape[1])), radius, best[at])
        warped[at] += 1
        lower[at, c] = np.where(np.isfinite(d), d, best[at])
        won = (d < best[at]) | ((d == best[at]) & (c < label[at]))
        best[at[won]], label[at[won]] = d[won], c
    return label, best, lower, warped, spared


def align_sums(x: np.ndarray, centroid: np.ndarray, radius: int | None) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the centroid, the sum and number of the values that the rows' paths bring there."""
    sums, counts = align_sums_by(x, np.zeros(len(x), np.int64), centroid[None, :], radius)
    return sums[0], counts[0]


def align_sums_by(x: np.ndarray, label: np.ndarray, centroids: np.ndarray, radius: int | None) -> tuple[np.ndarray, np.ndarray]:
    """align_sums() of several centroids at once, each by the rows with its label."""
    k, n = centroids.shape
    if n == x.shape[1] and band(n, n, radius)[0] <= NARROW and np.isfinite(x).all() and np.isfinite(centroids).all():
        return _narrow_sums(x, label, centroids, band(n, n, radius)[0])
    sums, counts = np.zeros(k * n), np.zeros(k * n)
    step = path_batch(n, x.shape[1], radius)
    for at in range(0, len(x), step):
        part, own = x[at : at + step], label[at : at + step]
        row, i, j = (np.concatenate(v) for v in zip(*_steps_back(centroids[own], part, radius)[1]))
        place = own[row] * n + i
        sums += np.bincount(place, weights=part[row, j], minlength=k * n)
        counts += np.bincount(place, minlength=k * n)
    return sums.reshape(k, n), counts.reshape(k, n)


def _narrow_sums(x: np.ndarray, label: np.ndarray, centroids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """align_sums_by() of finite rows as long as the centroids, in a narrow band: paths are marked on all its cells, a row of
    the matrix at a time, so no step is looked up by itself. Rows are taken by label, and a batch's labels are runs."""
    k, n = centroids.shape
    sums, counts = np.zeros((k, n)), np.zeros((k, n))
    order = np.argsort(label, kind="stable")
    step = path_batch(n, n, radius)
    step = -(-len(x) // max(1, -(-len(x) // step))) or 1  # even batches, as a small one costs nearly as much
    for at in range(0, len(x), step):
        rows = order[at : at + step]
        own = label[rows]
        runs = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        s, c = _marked_sums(np.ascontiguousarray(centroids[own].T), x[rows].T, radius, runs)
        sums[own[runs]] += s
        counts[own[runs]] += c
    return sums, counts


def _marked_sums(a: np.ndarray, b: np.ndarray, radius: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts), a row for each run of pairs, of a and b (n, pairs). A cell is held at j - i + radius, so the diagonal
    step keeps its place, the one above is a place further and the left one a place back."""
    n, size = a.shape
    width = 2 * radius + 1
    padded = np.zeros((n + 2 * radius, size))
    padded[radius : radius + n] = b
    above, left = np.zeros((n, width, size), bool), np.zeros((n, width, size), bool)  # the steps back, else diagonal
    before, now = np.full((width + 1, size), INF), np.full((width + 1, size), INF)
    best, cost = np.empty((width, size)), np.empty((width, size))
    for i in range(n):
        np.subtract(a[i], padded[i : i + width], out=cost)
        np.multiply(cost, cost, out=cost)
        cost[: max(0, radius - i)] = INF
        cost[n - i + radius :] = INF
        if i:
            np.less(before[1:], before[:-1], out=above[i])
            np.minimum(before[1:], before[:-1], out=best)
        else:
            best[:] = INF
            best[radius] = 0.0
        np.add(best[0], cost[0], out=now[0])
        for o in range(1, width):
            np.less(now[o - 1], best[o], out=left[i, o])
            np.minimum(best[o], now[o - 1], out=best[o])
            np.add(best[o], cost[o], out=now[o])
        before, now = now, before
    sums, counts = np.empty((n, len(runs))), np.empty((n, len(runs)))
    on, go = np.zeros((width, size), bool), np.empty((width, size), bool)
    on[radius] = True
    for i in range(n - 1, -1, -1):
        for o in range(width - 1, 0, -1):
            np.logical_and(on[o], left[i, o], out=go[0])
            np.logical_or(on[o - 1], go[0], out=on[o - 1])
        np.multiply(padded[i : i + width], on, out=cost)
        np.add.reduceat(np.add.reduce(cost, axis=0), runs, out=sums[i])
        np.add.reduceat(np.add.reduce(on.view(np.uint8), axis=0, dtype=np.uint8), runs, dtype=float, out=counts[i])
        np.greater(on, left[i], out=go)
        np.logical_and(go, above[i], out=above[i])
        np.logical_xor(go, above[i], out=on)
        np.logical_or(on[1:], above[i, :-1], out=on[1:])
    return sums.T, counts.T


def medoid(x: np.ndarray, radius: int | None) -> int:
    """The row with the least sum of distances to all; of ties the first. Holds PATCH pairs at a time."""
    total = np.zeros(len(x))
    for rows, columns, d in table(x, None, radius):
        total[rows] += d.sum(axis=1)
        total[columns] += d.sum(axis=0)
    return int(np.argmin(total))


def dba(x: np.ndarray, radius: int | None, init: str = "mean", max_iter: int = 10, tol: float = 1e-5, fraction: float = 1.0, seed: int = 42, sample=None, start: np.ndarray | None = None):
    """(centroid, converged, iterations, change, mode) of barycenter averaging. sample: gives the rows of each step,
    from 0 on, below a fraction of 1; else they are drawn from the seed. start: the first centroid, if it is known."""
    take, rng = max(1, int(np.ceil(len(x) * fraction))), np.random.default_rng(seed)
    some = sample or (lambda step: rng.permutation(len(x))[:take])
    centroids, converged, done, change = dba_groups(x, [np.arange(len(x))], radius, init, max_iter, tol, fraction, [some], None if start is None else start[None, :])
    return centroids[0], bool(converged[0]), int(done[0]), float(change[0]), "full" if take >= len(x) else "stochastic"


def dba_groups(x: np.ndarray, members: list[np.ndarray], radius: int | None, init: str, max_iter: int, tol: float, fraction: float, samples: list, starts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(centroids, converged, iterations, change) of several groups of rows, each stopping by itself; the paths of all
    groups are made in common batches. samples: for each group what gives the rows of each step, by their places in it. starts:
    first centroids, if they are known."""
    start = lambda m: x[m[medoid(x[m], radius)]] if init == "medoid" else x[m].mean(axis=0)
    centroids = np.stack([start(m) for m in members]) if starts is None else starts.copy()
    done, change, going = np.zeros(len(members), np.int64), np.full(len(members), INF), np.arange(len(members))
    for step in range(max_iter):
        full = [max(1, int(np.ceil(len(m) * fraction))) >= len(m) for m in members]
        parts = [members[c] if full[c] else members[c][samples[c](step)] for c in going]
        sums, counts = align_sums_by(x[np.concatenate(parts)], np.repeat(np.arange(len(going)), [len(m) for m in parts]), centroids[going], radius)
        new = np.where(counts > 0, sums / np.maximum(counts, 1), centroids[going])
        change[going], done[going] = np.abs(new - centroids[going]).max(axis=1), step + 1
        centroids[going] = new
        going = going[change[going] >= tol]
        if not len(going):
            break
    return centroids, change < tol, done, change


def ssg(x: np.ndarray, radius: int | None, max_epochs: int = 20, rate: float = 0.1, decay: float = 0.01, tol: float = 1e-5, seed: int = 42, order=None):
    """(centroid, converged, epochs, steps) of stochastic subgradient averaging: the members one by one, each
    step of a path pulling its place of the centroid. order: gives the members' order in each epoch, from 1 on; else
    it is drawn from the seed."""
    centroid, rng = x.mean(axis=0), np.random.default_rng(seed)
    steps, epoch, converged = 0, 0, False
    for epoch in range(1, max_epochs + 1):
        steps, largest = ssg_pass(x[order(epoch) if order else rng.permutation(len(x))], centroid, radius, steps, rate, decay)
        if largest < tol:
            converged = True
            break
    return centroid, converged, epoch, steps


def ssg_pass(x: np.ndarray, centroid: np.ndarray, radius: int | None, steps: int, rate: float, decay: float) -> tuple[int, float]:
    """Moves the centroid by the rows in their order. (steps so far, largest move)."""
    largest = 0.0
    for row in x:
        steps += 1
        lr = rate / (1 + decay * steps)
        values, at = row.tolist(), centroid.tolist()
        for p, q in path_of(centroid, row, radius):
            move = lr * (values[q] - at[p])
            at[p] += move
            largest = max(largest, abs(move))
        centroid[:] = at
    return steps, largest
