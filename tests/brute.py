"""Plain-Python statement of the replay contract, for small fixtures."""

from __future__ import annotations

import math


def watermark_series(ts, bound, emit_every=1, lanes=1):
    """Per row (in arrival order): m_vis, m_after (the max behind the watermark)."""
    n = len(ts)
    lane_max = [None] * lanes
    vis, after = [], []
    cur = None              # last emitted combined max
    for i, t in enumerate(ts):
        vis.append(cur)
        ln = i % lanes
        if t is not None:
            lane_max[ln] = t if lane_max[ln] is None else max(lane_max[ln], t)
        if (i + 1) % emit_every == 0:
            f = None if any(v is None for v in lane_max) else min(lane_max)
            if f is not None:
                cur = f if cur is None else max(cur, f)
        after.append(cur)
    return vis, after


def replay(rows, bound, size, slide=None, emit_every=1, lanes=1):
    """rows: list of (t, key, value) in arrival order.

    Returns (result dict {(ws, key): (sum, delay)}, late row indexes).
    """
    slide = slide or size
    ts = [r[0] for r in rows]
    vis, after = watermark_series(ts, bound, emit_every, lanes)
    k = math.ceil(size / slide)
    sums, late = {}, []
    for i, (t, key, v) in enumerate(rows):
        if t is None:
            continue
        wm = None if vis[i] is None else vis[i] - bound
        base = t - t % slide
        wins = [base - j * slide for j in range(k) if t < base - j * slide + size]
        if not wins:            # in a gap between hopping windows: nothing to be late for
            continue
        open_ = [ws for ws in wins if not (wm is not None and ws + size - 1 <= wm)]
        if not open_:
            late.append(i)
            continue
        if key is None:
            continue
        for ws in open_:
            sums[(ws, key)] = sums.get((ws, key), 0) + v
    fires = [a for a in after if a is not None]
    out = {}
    for (ws, key), s in sums.items():
        e = ws + size
        m = next((a for a in fires if a - bound >= e - 1), None)
        out[(ws, key)] = (s, -1 if m is None else m - e)
    return out, late


def update_log(rows, bound, size, slide=None, lateness=0):
    """rows: list of (t, key, value) in arrival order.  Returns (log, late row
    indexes, open windows after each row): the log holds (ws, key, update, sum,
    delay, flushed) of first firings and of every row after them."""
    slide = slide or size
    vis, after = watermark_series([r[0] for r in rows], bound)
    k = math.ceil(size / slide)
    sums, told, log, late, open_after = {}, {}, [], [], []
    for i, (t, key, v) in enumerate(rows):
        wm = None if vis[i] is None else vis[i] - bound
        if t is not None:
            base = t - t % slide
            wins = [base - j * slide for j in range(k) if t < base - j * slide + size]
            here = [ws for ws in wins if wm is None or ws + size - 1 + lateness > wm]
            if wins and not here:
                late.append(i)
            for ws in here if key is not None else []:
                w = (ws, key)
                sums[w] = sums.get(w, 0) + v
                if wm is not None and ws + size - 1 <= wm:
                    log.append((ws, key, told.get(w, 0), sums[w], vis[i] - ws - size, False))
                    told[w] = told.get(w, 0) + 1
        if after[i] is not None:
            for ws, key in sorted(sums):
                if (ws, key) not in told and ws + size - 1 <= after[i] - bound:
                    log.append((ws, key, 0, sums[ws, key], after[i] - ws - size, False))
                    told[ws, key] = 1
        open_after.append(sorted(w for w in sums if w not in told or w[0] + size - 1 + lateness > after[i] - bound))
    log += [(ws, key, 0, s, -1, True) for (ws, key), s in sums.items() if (ws, key) not in told]
    return log, late, open_after
