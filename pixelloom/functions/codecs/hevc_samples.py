"""Samples of HEVC pictures: intra prediction, inverse quantization and transforms, deblocking, sample-adaptive offset."""

from __future__ import annotations

import numpy as np

#: The transform's cosines of k pi / 64, k from 0, and the sine transform of 4x4 luma blocks.
COSINES = [64, 90, 90, 90, 89, 88, 87, 85, 83, 82, 80, 78, 75, 73, 70, 67, 64, 61, 57, 54, 50, 46, 43, 38, 36, 31, 25, 22, 18, 13, 9, 4, 0]
SINES = np.array([[29, 55, 74, 84], [74, 74, 0, -74], [84, -29, -74, 55], [55, -84, 74, -29]], np.int64)
#: Steps by QP modulo 6; angles of modes 2 to 34; chroma QP of 30 to 42.
STEPS = [40, 45, 51, 57, 64, 72]
ANGLES = [32, 26, 21, 17, 13, 9, 5, 2, 0, -2, -5, -9, -13, -17, -21, -26, -32, -26, -21, -17, -13, -9, -5, -2, 0, 2, 5, 9, 13, 17, 21, 26, 32]
CHROMA_QP = [29, 30, 31, 32, 33, 33, 34, 34, 35, 35, 36, 36, 37]
#: Thresholds of the deblocking filter by QP.
BETA = np.array([0] * 16 + list(range(6, 19)) + list(range(20, 66, 2)))
TC = np.array([0] * 18 + [1] * 9 + [2] * 4 + [3] * 4 + [4] * 3 + [5, 5, 6, 6, 7, 8, 9, 10, 11, 13, 14, 16, 18, 20, 22, 24])


def cosine(k: int) -> int:
    k %= 128
    k = 128 - k if k > 64 else k
    return COSINES[k] if k <= 32 else -COSINES[64 - k]


#: By logarithm of the size; rows are frequencies.
TRANSFORMS = {k: np.array([[cosine(f * (32 >> k) * (2 * i + 1)) for i in range(1 << k)] for f in range(1 << k)], np.int64) for k in range(2, 6)}


def chroma_qp(index: int) -> int:
    return index if index < 30 else CHROMA_QP[index - 30] if index < 43 else index - 6


def residual(levels: np.ndarray, qp: int, factors, log2: int, skipped: int, sine: bool) -> np.ndarray:
    shift = log2 + 3
    scaled = np.clip((levels * factors * (STEPS[qp % 6] << qp // 6) + (1 << shift - 1)) >> shift, -32768, 32767)
    if skipped:
        return (scaled * 128 + 2048) >> 12
    basis = SINES if sine else TRANSFORMS[log2]
    columns = np.clip((basis.T @ scaled + 64) >> 7, -32768, 32767)
    return (columns @ basis + 2048) >> 12


def border(plane: np.ndarray, owner: np.ndarray, me: int, x: int, y: int, n: int, component: int) -> np.ndarray:
    """The 4n + 1 samples around a block, from the lowest left one up to the corner and then to the right; those not made come from their neighbours."""
    unit, line, known = 4 >> (component > 0), np.zeros(4 * n + 1, np.int32), np.zeros(4 * n + 1, bool)
    u, v = x // unit, y // unit
    if x:
        left, ok = plane[y : y + 2 * n, x - 1], (owner[v : v + 2 * n // unit, u - 1] == me).repeat(unit)
        line[2 * n - len(left) : 2 * n], known[2 * n - len(left) : 2 * n] = left[::-1], ok[: len(left)][::-1]
    if x and y:
        line[2 * n], known[2 * n] = plane[y - 1, x - 1], owner[v - 1, u - 1] == me
    if y:
        top, ok = plane[y - 1, x : x + 2 * n], (owner[v - 1, u : u + 2 * n // unit] == me).repeat(unit)
        line[2 * n + 1 : 2 * n + 1 + len(top)], known[2 * n + 1 : 2 * n + 1 + len(top)] = top, ok[: len(top)]
    if not known.any():
        line[:] = 128
        return line
    nearest = np.maximum.accumulate(np.where(known, np.arange(len(line)), -1))
    return line[np.where(nearest < 0, known.argmax(), nearest)]


def smoothed(line: np.ndarray, n: int, mode: int, strong: int) -> np.ndarray:
    far = 10 if mode == 0 else min(abs(mode - 26), abs(mode - 10))
    if mode == 1 or n == 4 or far <= {8: 7, 16: 1, 32: 0}[n]:
        return line
    low, corner, high = line[0], line[2 * n], line[-1]
    if strong and n == 32 and abs(corner + high - 2 * line[3 * n]) < 8 and abs(corner + low - 2 * line[n]) < 8:
        d = np.arange(1, 65)
        rest = lambda end: ((64 - d) * corner + d * end + 32) >> 6
        return np.concatenate([rest(low)[::-1], [corner], rest(high)])
    out = line.copy()
    out[1:-1] = (line[:-2] + 2 * line[1:-1] + line[2:] + 2) >> 2
    return out


def predict(line: np.ndarray, n: int, mode: int, luma: bool, strong: int) -> np.ndarray:
    if luma:
        line = smoothed(line, n, mode, strong)
    left, corner, top, k = line[2 * n - 1 :: -1], int(line[2 * n]), line[2 * n + 1 :], np.arange(n)
    if mode == 0:
        x, y = k[None, :], k[:, None]
        return ((n - 1 - x) * left[:n, None] + (x + 1) * top[n] + (n - 1 - y) * top[None, :n] + (y + 1) * left[n] + n) >> n.bit_length()
    if mode == 1:
        mean = (int(top[:n].sum()) + int(left[:n].sum()) + n) >> n.bit_length()
        out = np.full((n, n), mean, np.int32)
        if luma and n < 32:
            out[0], out[:, 0] = (top[:n] + 3 * mean + 2) >> 2, (left[:n] + 3 * mean + 2) >> 2
            out[0, 0] = (left[0] + 2 * mean + top[0] + 2) >> 2
        return out
    if mode < 18:
        return along(left, top, corner, n, ANGLES[mode - 2], luma).T
    return along(top, left, corner, n, ANGLES[mode - 2], luma)


def along(main: np.ndarray, side: np.ndarray, corner: int, n: int, angle: int, luma: bool) -> np.ndarray:
    """Prediction from the main border downwards, `angle` 32nds of a sample to the right a row."""
    ref = np.zeros(3 * n + 2, np.int32)  # place 0 of the main border's line, its corner, is at n
    ref[n], ref[n + 1 : 3 * n + 1] = corner, main
    last = n * angle >> 5
    if angle < 0 and last < -1:
        back, inverse = np.arange(last, 0), round(8192 / angle)
        ref[n + last : n] = side[((back * inverse + 128) >> 8) - 1]
    moved = np.arange(1, n + 1)[:, None] * angle
    at, part = np.arange(n)[None, :] + (moved >> 5) + 1 + n, moved & 31
    out = ((32 - part) * ref[at] + part * ref[at + 1] + 16) >> 5
    if angle == 0 and luma and n < 32:
        out[:, 0] = np.clip(main[0] + ((side[:n] - corner) >> 1), 0, 255)
    return out


def deblock(picture) -> None:
    """Vertical edges of the whole picture, then horizontal ones. All blocks are intra, so every edge has strength 2."""
    flags = np.array([[0, 0, 0, 0]] + [[h.no_deblock, h.across, h.beta, h.tc] for h in picture.slices])
    for edges, turn in ((picture.left_edge, False), (picture.top_edge, True)):
        maps = [edges, picture.owner, picture.qp, picture.bypass, *picture.planes]
        edges, owner, qp, bypass, *planes = [m.T for m in maps] if turn else maps
        rows, columns = np.nonzero(edges)
        keep = (columns > 0) & (columns % 2 == 0)
        rows, columns = rows[keep], columns[keep]
        q, p = owner[rows, columns], owner[rows, columns - 1]
        keep = (flags[q, 0] == 0) & ((q == p) | (flags[q, 1] == 1))
        rows, columns, q = rows[keep], columns[keep], flags[q[keep]]
        if not len(rows):
            continue
        mean = (qp[rows, columns] + qp[rows, columns - 1] + 1) >> 1
        fixed = [bypass[rows, columns - 1] == 1, bypass[rows, columns] == 1]
        beta, tc = BETA[np.clip(mean + q[:, 2], 0, 51)], TC[np.clip(mean + 2 + q[:, 3], 0, 53)]
        deblock_luma(planes[0], rows, columns, beta, tc, fixed)
        wide = columns % 4 == 0
        for plane, shift in zip(planes[1:], picture.p.chroma_qp):
            index = [chroma_qp(int(m) + shift) for m in mean[wide]]
            limits = TC[np.clip(np.array(index, int) + 2 + q[wide, 3], 0, 53)]
            deblock_chroma(plane, rows[wide], columns[wide], limits, [f[wide] for f in fixed])


def deblock_luma(plane, rows, columns, beta, tc, fixed) -> None:
    ys, xs = rows[:, None, None] * 4 + np.arange(4)[None, :, None], columns[:, None, None] * 4 + np.arange(-4, 4)[None, None, :]
    v = plane[ys, xs].astype(np.int64)
    p3, p2, p1, p0, q0, q1, q2, q3 = (v[:, :, i] for i in range(8))
    dp, dq = np.abs(p2 - 2 * p1 + p0), np.abs(q2 - 2 * q1 + q0)
    ends = dp + dq
    active = ends[:, 0] + ends[:, 3] < beta
    smooth = np.ones(len(rows), bool)
    for i in (0, 3):
        flat = np.abs(p3[:, i] - p0[:, i]) + np.abs(q0[:, i] - q3[:, i]) < beta >> 3
        smooth &= (2 * ends[:, i] < beta >> 2) & flat & (np.abs(p0[:, i] - q0[:, i]) < (5 * tc + 1) >> 1)
    t = tc[:, None]
    near = lambda new, old: np.clip(new, old - 2 * t, old + 2 * t)
    full = [
        p3,
        near((2 * p3 + 3 * p2 + p1 + p0 + q0 + 4) >> 3, p2),
        near((p2 + p1 + p0 + q0 + 2) >> 2, p1),
        near((p2 + 2 * p1 + 2 * p0 + 2 * q0 + q1 + 4) >> 3, p0),
        near((p1 + 2 * p0 + 2 * q0 + 2 * q1 + q2 + 4) >> 3, q0),
        near((p0 + q0 + q1 + q2 + 2) >> 2, q1),
        near((p0 + q0 + q1 + 3 * q2 + 2 * q3 + 4) >> 3, q2),
        q3,
    ]
    step = (9 * (q0 - p0) - 3 * (q1 - p1) + 8) >> 4
    used = np.abs(step) < 10 * t
    step = np.where(used, np.clip(step, -t, t), 0)
    side = ((beta + (beta >> 1)) >> 3)[:, None]
    inner_p = np.clip((((p2 + p0 + 1) >> 1) - p1 + step) >> 1, -(t >> 1), t >> 1)
    inner_q = np.clip((((q2 + q0 + 1) >> 1) - q1 - step) >> 1, -(t >> 1), t >> 1)
    bend_p, bend_q = (dp[:, 0] + dp[:, 3])[:, None] < side, (dq[:, 0] + dq[:, 3])[:, None] < side
    weak = [p3, p2, p1 + np.where(used & bend_p, inner_p, 0), p0 + step, q0 - step, q1 + np.where(used & bend_q, inner_q, 0), q2, q3]
    out = np.where(smooth[:, None, None], np.stack(full, 2), np.clip(np.stack(weak, 2), 0, 255))
    out = np.where(active[:, None, None], out, v)
    out[fixed[0], :, :4], out[fixed[1], :, 4:] = v[fixed[0], :, :4], v[fixed[1], :, 4:]
    plane[ys, xs] = out


def deblock_chroma(plane, rows, columns, tc, fixed) -> None:
    ys, xs = rows[:, None, None] * 2 + np.arange(2)[None, :, None], columns[:, None, None] * 2 + np.arange(-2, 2)[None, None, :]
    v = plane[ys, xs].astype(np.int64)
    p1, p0, q0, q1 = (v[:, :, i] for i in range(4))
    step = np.clip((((q0 - p0) << 2) + p1 - q1 + 4) >> 3, -tc[:, None], tc[:, None])
    v[:, :, 1] = np.where(fixed[0][:, None], p0, np.clip(p0 + step, 0, 255))
    v[:, :, 2] = np.where(fixed[1][:, None], q0, np.clip(q0 - step, 0, 255))
    plane[ys, xs] = v


def offset(picture) -> None:
    """Adds offsets by band or by direction to each tree block; neighbours come from the picture before any offset."""
    across = np.array([1] + [h.across for h in picture.slices])
    for component, plane in enumerate(picture.planes):
        before, shift = plane.copy(), int(component > 0)
        height, width = plane.shape
        size, unit = 1 << picture.s.ctb - shift, 4 >> shift
        for (cx, cy), found in picture.sao.items():
            kind, place, offsets = found[component]
            if not kind:
                continue
            x, y = cx * size, cy * size
            ys, xs = np.mgrid[y : min(y + size, height), x : min(x + size, width)]
            v = before[ys, xs]
            if kind == 1:
                table = np.zeros(32, np.int32)
                for i, n in enumerate(offsets):
                    table[(place + i) & 31] = n
                change = table[v >> 3]
            else:
                dx, dy = ((-1, 0), (0, -1), (-1, -1), (1, -1))[place]
                mine, sign, usable = picture.owner[ys // unit, xs // unit], 0, True
                for a, b in ((dx, dy), (-dx, -dy)):
                    ny, nx = ys + b, xs + a
                    inside = (ny >= 0) & (ny < height) & (nx >= 0) & (nx < width)
                    ny, nx = np.clip(ny, 0, height - 1), np.clip(nx, 0, width - 1)
                    other = picture.owner[ny // unit, nx // unit]
                    usable = usable & inside & ((other == mine) | (across[np.maximum(other, mine)] == 1))
                    sign = sign + np.sign(v - before[ny, nx])
                change = np.where(usable, np.array([offsets[0], offsets[1], 0, offsets[2], offsets[3]])[sign + 2], 0)
            change = np.where(picture.bypass[ys // unit, xs // unit] == 1, 0, change)
            plane[ys, xs] = np.clip(v + change, 0, 255)
