"""Plans of several rooms: their surfaces, what a ray meets first, and the energy and paths that arrive.

Surfaces are upright rectangles (walls, windows, sides of furniture) and level ones
(tops), above one floor and below one ceiling. They are grouped into boxes by halving
along their longest extent; rays that miss a box skip what it holds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import permutations

import numpy as np

from roomlake.functions import acoustics, shapes
from roomlake.functions.geometry import AIR_LOSS, BANDS, SPEED
from roomlake.functions.tracer import directions

#: Heights (m) of doors, sills and windows where a plan doesn't say, how far a portal's points lie inside the rooms, and the least piece of a wall.
DOOR, SILL, WINDOW, INSIDE, LEAST = 2.1, 0.9, 1.2, 0.08, 0.015
#: Absorption and loss (dB) of the kinds of surface.
KINDS = {"wall": (0.06, (38, 42, 46, 50, 52, 54)), "door": (0.14, (20, 23, 26, 29, 31, 33)), "window": (0.08, (22, 25, 28, 31, 33, 35)), "object": (0.30, (30, 33, 36, 39, 41, 43))}
FLOOR, CEILING, SCATTERING = 0.10, 0.08, 0.12
IN_A_BOX = 8
MOST_BENDS, MOST_PATHS = 3, 8


def compile_plan(plan: Mapping, height: float = 2.8, objects: Sequence[Mapping] = ()) -> dict:
    """A plan (rooms, openings) as surfaces and portals: rows [ax, ay, bx, by, z_low, z_high] with a kind each, and level ones [x, y, ux, uy, vx, vy, z]."""
    upright, kinds = [], []

    def add(a, b, low, high, kind):
        if high - low >= LEAST and np.linalg.norm(b - a) >= LEAST:
            upright.append([*a, *b, low, high])
            kinds.append(kind)

    for room in plan["rooms"]:
        p = np.asarray(room["corners"], float)
        for a, b in zip(p, np.roll(p, -1, 0)):
            length = np.linalg.norm(b - a)
            along, cuts = (b - a) / length, []
            for o in plan["openings"]:
                s = np.asarray(o["segment"], float) - a
                if np.abs(s[:, 0] * along[1] - s[:, 1] * along[0]).max() < 0.03:
                    low, high = sorted((s @ along).tolist())
                    if min(high, length) - max(low, 0) > LEAST:
                        cuts.append((max(low, 0.0), min(high, length), o))
            at = 0.0
            for low, high, o in sorted(cuts, key=lambda c: c[:2]):
                add(a + at * along, a + low * along, 0.0, height, "wall")
                window = o["type"] == "window"
                sill = float(o.get("sill_height_m", SILL if window else 0.0))
                top = min(height, sill + float(o.get("height_m", WINDOW if window else DOOR)))
                add(a + low * along, a + high * along, 0.0, sill, "wall")
                add(a + low * along, a + high * along, top, height, "wall")
                if not o.get("open"):
                    add(a + low * along, a + high * along, sill, top, "window" if window else "door")
                at = max(at, high)
            add(a + at * along, b, 0.0, height, "wall")
    level = []
    for o in objects:
        (x, y), (w, d, h), turn = o["position"], o["size"], np.radians(o.get("rotation", 0.0))
        u, v = np.array([np.cos(turn), np.sin(turn)]) * w / 2, np.array([-np.sin(turn), np.cos(turn)]) * d / 2
        c = np.array([x, y], float)
        ring = [c - u - v, c + u - v, c + u + v, c - u + v]
        for a, b in zip(ring, ring[1:] + ring[:1]):
            add(a, b, 0.0, min(h, height), "object")
        level.append([x, y, *u, *v, min(h, height - LEAST)])
    portals = []
    outlines = {r["id"]: np.asarray(r["corners"], float) for r in plan["rooms"]}
    for o in plan["openings"]:
        if o["connection"] == "interior_room" and len(o["room_ids"]) == 2:
            s = np.asarray(o["segment"], float)
            middle = s.mean(0)
            inner = {}
            for name in o["room_ids"]:
                to = outlines[name].mean(0) - middle
                inner[name] = (middle + to / max(np.linalg.norm(to), 1e-9) * INSIDE).tolist()
            width = float(np.linalg.norm(s[1] - s[0]))
            portals.append({"id": o["id"], "room_ids": list(o["room_ids"]), "room_points": inner, "center": middle.tolist(), "width": width, "height": float(o.get("height_m", DOOR)), "open": bool(o.get("open"))})
    return {"height": float(height), "upright": upright, "kinds": kinds, "level": level, "rooms": [{"id": k, "corners": p.tolist()} for k, p in outlines.items()], "portals": portals}


@dataclass
class Surfaces:
    """Arrays of a compiled plan, grouped into boxes."""

    a: np.ndarray
    edge: np.ndarray
    z: np.ndarray
    normal: np.ndarray
    level: np.ndarray
    alpha: np.ndarray
    loss: np.ndarray
    height: float
    boxes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, plan: Mapping) -> Surfaces:
        rows = np.asarray(plan["upright"], float).reshape(-1, 6)
        a, edge, z = rows[:, :2], rows[:, 2:4] - rows[:, :2], rows[:, 4:]
        normal = np.column_stack([-edge[:, 1], edge[:, 0], np.zeros(len(rows))]) / np.maximum(np.linalg.norm(edge, axis=1), 1e-12)[:, None]
        level = np.asarray(plan["level"], float).reshape(-1, 7)
        names = [*plan["kinds"], *["object"] * len(level)]
        one = np.ones(len(BANDS))
        alpha = np.array([*(KINDS[k][0] * one for k in names), FLOOR * one, CEILING * one])
        loss = np.array([KINDS[k][1] for k in names], float).reshape(-1, len(BANDS))
        low = np.column_stack([np.minimum(a, a + edge), z[:, 0]])
        high = np.column_stack([np.maximum(a, a + edge), z[:, 1]])
        return cls(a, edge, z, normal, level, alpha, loss, float(plan["height"]), halved(low, high))

    def first(self, at: np.ndarray, d: np.ndarray, most: np.ndarray | float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """For each ray how far it goes (in units of ``d``) and what it meets: upright, level, floor, ceiling; -1 for nothing within ``most``."""
        n, m = len(at), len(self.a)
        best, what = np.broadcast_to(np.asarray(most, float), n).copy(), np.full(n, -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            for k, (plane, down) in enumerate(((0.0, True), (self.height, False))):
                t = (plane - at[:, 2]) / d[:, 2]
                ok = ((d[:, 2] < 0) if down else (d[:, 2] > 0)) & (t > 1e-9) & (t < best)
                best, what = np.where(ok, t, best), np.where(ok, m + len(self.level) + k, what)
            for k, (x, y, ux, uy, vx, vy, z) in enumerate(self.level):
                t = (z - at[:, 2]) / d[:, 2]
                px, py = at[:, 0] + t * d[:, 0] - x, at[:, 1] + t * d[:, 1] - y
                ok = (t > 1e-9) & (t < best) & (np.abs(px * ux + py * uy) <= ux * ux + uy * uy) & (np.abs(px * vx + py * vy) <= vx * vx + vy * vy)
                best, what = np.where(ok, t, best), np.where(ok, m + k, what)
            for low, high, own in self.boxes:
                lo, hi = (low - 1e-6 - at) / d, (high + 1e-6 - at) / d
                enter, leave = np.fmax.reduce(np.fmin(lo, hi), axis=1), np.fmin.reduce(np.fmax(lo, hi), axis=1)
                rays = np.flatnonzero((enter <= leave) & (leave > 0) & (enter < best))
                if not len(rays):
                    continue
                r, e, to = d[rays], self.edge[own], self.a[own][None] - at[rays, None, :2]
                cross = r[:, None, 0] * e[:, 1] - r[:, None, 1] * e[:, 0]
                t = (to[..., 0] * e[:, 1] - to[..., 1] * e[:, 0]) / cross
                u = (to[..., 0] * r[:, None, 1] - to[..., 1] * r[:, None, 0]) / cross
                z = at[rays, None, 2] + t * r[:, None, 2]
                t = np.where((np.abs(cross) > 1e-12) & (t > 1e-9) & (u >= -1e-9) & (u <= 1 + 1e-9) & (z >= self.z[own, 0] - 1e-9) & (z <= self.z[own, 1] + 1e-9), t, np.inf)
                k = t.argmin(1)
                t = t[np.arange(len(rays)), k]
                nearer = t < best[rays]
                best[rays[nearer]], what[rays[nearer]] = t[nearer], own[k[nearer]]
        return best, what

    def facing(self, what: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The normals of what is met, on the side that a ray comes from."""
        level = np.tile([0.0, 0.0, 1.0], (len(self.level) + 2, 1))
        n = np.vstack([self.normal, level])[what]
        return n * np.where((n * d).sum(1) > 0, -1.0, 1.0)[:, None]

    def between(self, a, b) -> list[int]:
        """The surfaces that a straight line from one point to another crosses, floor and ceiling left out."""
        a, b = np.asarray(a, float), np.asarray(b, float)
        crossed, done = [], 0.0
        while done < 1:
            t, what = self.first((a + done * (b - a))[None], ((1 - done) * (b - a))[None], 1 - 1e-9)
            if what[0] < 0 or what[0] >= len(self.a) + len(self.level):
                break
            crossed.append(int(what[0]))
            done += t[0] * (1 - done) + 1e-6
        return crossed


def halved(low: np.ndarray, high: np.ndarray, most: int = IN_A_BOX) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bounds and members of boxes of ``most`` surfaces at most, by halving at the middle one along the longest extent."""
    out, queue = [], deque([np.arange(len(low))] if len(low) else [])
    while queue:
        own = queue.popleft()
        if len(own) <= most:
            out.append((low[own].min(0), high[own].max(0), own))
            continue
        middle = (low[own] + high[own]) / 2
        order = own[np.argsort(middle[:, int(np.ptp(middle, axis=0).argmax())], kind="stable")]
        queue.extend([order[: len(order) // 2], order[len(order) // 2 :]])
    return out


def trace(scene: Surfaces, source, listener, *, first_ray: int, rays: int, of_rays: int, bounces: int, bin_seconds: float, bins: int, seed: int, scattering: float = SCATTERING, block: int = 1024) -> np.ndarray:
    """Energy [band, bin] from the direct sound's time on that a part of the rays finds; they start at the listener and look for the source at every hit."""
    source, listener = np.asarray(source, float), np.asarray(listener, float)
    direct = np.linalg.norm(source - listener) / SPEED
    out = np.zeros((len(BANDS), bins))
    for begin in range(first_ray, first_ray + rays, block):
        n = min(block, first_ray + rays - begin)
        d, rng = directions(n, begin, of_rays), np.random.default_rng([seed, begin])
        at, gone, energy = np.tile(listener, (n, 1)), np.zeros(n), np.full((n, len(BANDS)), 4 / of_rays)
        for _ in range(bounces):
            t, what = scene.first(at, d)
            alive = what >= 0  # a ray may leave where a plan isn't closed
            if not alive.any():
                break
            at, d, gone, energy, t, what = at[alive], d[alive], gone[alive], energy[alive], t[alive], what[alive]
            normal = scene.facing(what, d)
            at = at + d * t[:, None] + 1e-6 * normal
            gone = gone + t
            energy = energy * (1 - scene.alpha[what])
            to = source - at
            far = np.maximum(np.linalg.norm(to, axis=1), 0.1)
            cosine = np.maximum((to * normal).sum(1) / far, 0)
            seen = cosine > 0
            seen[seen] = scene.first(at[seen], to[seen], 1.0)[1] < 0
            where = np.floor(((gone + far) / SPEED - direct) / bin_seconds).astype(int)
            seen &= (where >= 0) & (where < bins)
            for b in range(len(BANDS)):
                out[b] += np.bincount(where[seen], (energy[seen, b] * cosine[seen] / far[seen] ** 2), bins)
            u = rng.standard_normal(d.shape)
            spread = normal + u / np.linalg.norm(u, axis=1, keepdims=True)
            spread /= np.maximum(np.linalg.norm(spread, axis=1, keepdims=True), 1e-9)
            d = np.where((rng.random(len(d)) < scattering)[:, None], spread, d - 2 * (d * normal).sum(1, keepdims=True) * normal)
    times = (np.arange(bins) + 0.5) * bin_seconds + direct
    return out * np.exp(-2 * np.asarray(AIR_LOSS)[:, None] * times * SPEED)


def _path(kind: str, points, gains, bends: int = 0) -> dict:
    length = float(np.linalg.norm(np.diff(np.asarray(points, float), axis=0), axis=1).sum())
    return {"kind": kind, "delay": length / SPEED, "length": length, "bends": bends, "gains": [float(g) for g in gains]}


def direct_path(scene: Surfaces, source, receiver) -> dict:
    """The straight path, with what the surfaces in its way let through."""
    crossed = scene.between(source, receiver)
    far = max(float(np.linalg.norm(np.subtract(source, receiver))), 0.1)
    passed = acoustics.through_layers(scene.loss[crossed]) if crossed else np.ones(len(BANDS))
    return _path("direct", [source, receiver], passed * np.exp(-np.asarray(AIR_LOSS) * far) / far) | {"crossed": len(crossed)}


def room_of(plan: Mapping, point) -> str | None:
    """The first room that holds a point."""
    return next((r["id"] for r in plan["rooms"] if shapes.contains(np.asarray(point, float)[:2], r["corners"])[0]), None)


def route(plan: Mapping, start: str, end: str) -> list[Mapping] | None:
    """The open portals of a way with the fewest of them; None without a way."""
    came: dict[str, tuple[str, Mapping] | None] = {start: None}
    queue = deque([start])
    while queue and end not in came:
        here = queue.popleft()
        for p in plan["portals"]:
            if p["open"] and here in p["room_ids"]:
                there = p["room_ids"][p["room_ids"][0] == here]
                if there not in came:
                    came[there] = (here, p)
                    queue.append(there)
    if end not in came:
        return None
    way = []
    while came[end] is not None:
        end, portal = came[end]
        way.append(portal)
    return way[::-1]


def portal_points(plan: Mapping, source, receiver, way: Sequence[Mapping], start: str) -> list[list[float]]:
    """The way from source to receiver on the level of the source: around corners within rooms, through portals between."""
    outlines = {r["id"]: r["corners"] for r in plan["rooms"]}
    here, at, points = start, np.asarray(source, float)[:2], [np.asarray(source, float)[:2]]
    for p in way:
        there = p["room_ids"][p["room_ids"][0] == here]
        points += list(shapes.shortest_path(at, p["room_points"][here], outlines[here])[1:])
        points.append(np.asarray(p["room_points"][there], float))
        here, at = there, points[-1]
    points += list(shapes.shortest_path(at, np.asarray(receiver, float)[:2], outlines[here])[1:])
    kept = [points[0]]
    for p in points[1:]:
        if np.linalg.norm(p - kept[-1]) > 1e-6:
            kept.append(p)
    return [[float(x), float(y), float(np.asarray(source, float)[2])] for x, y in kept]


def portal_paths(plan: Mapping, source, receiver) -> list[dict]:
    """The path through open portals between two rooms, with what bends and apertures take; none within one room or without a way."""
    start, end = room_of(plan, source), room_of(plan, receiver)
    if start is None or end is None or start == end or (way := route(plan, start, end)) is None:
        return []
    centers = [[*p["center"], min(float(p["height"]) / 2, float(np.asarray(source)[2]))] for p in way]
    found = acoustics.portal_path(source, receiver, centers, [p["width"] * p["height"] for p in way])
    return [_path("portal", found["points"], found["gains"], len(way))]


def bent_paths(corners, source, receiver, *, order: int = MOST_BENDS, most: int = MOST_PATHS) -> list[dict]:
    """Paths around the inner corners of an outline whose middle line is blocked, by delay."""
    p = np.asarray(corners, float)
    p = p if shapes.signed_area(p) > 0 else p[::-1]
    a, b = np.asarray(source, float), np.asarray(receiver, float)
    free = lambda x, y: bool(shapes.contains(x + np.linspace(0, 1, 34)[1:-1, None] * (y - x), p).all())
    if free(a[:2], b[:2]):
        return []
    before, after = np.roll(p, 1, 0), np.roll(p, -1, 0)
    inner = [k for k in range(len(p)) if np.cross([*(p[k] - before[k]), 0], [*(after[k] - p[k]), 0])[2] < -1e-12]
    nodes = {-1: a[:2], -2: b[:2]} | {k: p[k] for k in inner}
    sees = {(i, j): free(nodes[i], nodes[j]) for i in nodes for j in nodes if i != j}
    found = []
    for n in range(1, order + 1):
        for way in permutations(inner, n):
            steps = [-1, *way, -2]
            if not all(sees[s] for s in zip(steps, steps[1:])):
                continue
            flat = np.array([nodes[k] for k in steps])
            legs = np.diff(flat, axis=0)
            far = np.linalg.norm(legs, axis=1)
            share = np.concatenate([[0], np.cumsum(far)]) / far.sum()
            points = np.column_stack([flat, a[2] + share * (b[2] - a[2])])
            units = legs / np.maximum(far, 1e-9)[:, None]
            turn = float(np.arccos(np.clip((units[:-1] * units[1:]).sum(1), -1, 1)).sum())
            length = np.linalg.norm(np.diff(points, axis=0), axis=1).sum()
            found.append(_path("diffraction", points, np.exp(-np.asarray(AIR_LOSS) * length) / max(length, 0.1) * acoustics.path_gain(turn)[0], n))
    return sorted(found, key=lambda x: (x["delay"], -max(x["gains"])))[:most]


def paths(plan: Mapping, scene: Surfaces, source, receiver) -> list[dict]:
    """All discrete paths, by delay, kind and strength: direct, through portals, and around corners within a room."""
    room = room_of(plan, source)
    found = [direct_path(scene, source, receiver), *portal_paths(plan, source, receiver)]
    if room is not None and room == room_of(plan, receiver):
        found += bent_paths(next(r["corners"] for r in plan["rooms"] if r["id"] == room), source, receiver)
    return sorted(found, key=lambda x: (x["delay"], x["kind"], -max(x["gains"])))


def render(found: Sequence[Mapping], echogram: np.ndarray, rt60: Sequence[float], *, fs: int, seconds: float, bin_seconds: float, seed: int, transition: float = 1.0) -> np.ndarray:
    """[band, sample]: discrete paths by band, noise under each band's energy from the first sound on, and a late network that takes over."""
    n = max(1, round(seconds * fs))
    out = np.zeros((len(BANDS), n))
    for path in found:
        at = round(path["delay"] * fs)
        if at < n:
            for b, g in enumerate(path["gains"]):
                out[b, at] += g
    pulse = np.zeros(n)
    for b in range(len(BANDS)):
        if out[b].any():
            out[b] = acoustics.split_bands(out[b], fs)[b]
    start = round(min((p["delay"] for p in found), default=0.0) * fs)
    noise = acoustics.split_bands(np.random.default_rng(seed).standard_normal(n), fs)
    width = max(1, round(bin_seconds * fs))
    late = acoustics.late_network(rt60, fs, n, seed=seed + 1) if max(rt60, default=0) > 0 else pulse
    late = acoustics.split_bands(late, fs) if late.any() else np.zeros((len(BANDS), n))
    for b in range(len(BANDS)):
        tail = np.zeros(n)
        for k in np.flatnonzero(echogram[b]):
            lo, hi = start + k * width, min(n, start + (k + 1) * width)
            power = float((noise[b, lo:hi] ** 2).sum()) if lo < n else 0.0
            if power > 0:
                tail[lo:hi] = noise[b, lo:hi] * np.sqrt(echogram[b, k] / power)
        out[b] += acoustics.crossfade(tail, late[b], transition, fs) if rt60[b] > 0 and transition * fs < n else tail
    return out
