"""One image at a time, a number at a time: palette search, remap and diffusion in plain Python, for comparison."""

import math

GAMMA = 0.5499 / 0.45455


def floats(r, g, b, a=255):
    return (a / 255, *((c / 255) ** GAMMA * a / 255 for c in (r, g, b)))


def difference(p, q):
    return sum(max((x - y) ** 2, (x - y + q[0] - p[0]) ** 2) for x, y in zip(p[1:], q[1:], strict=True))


def mean(items, weights):
    total = sum(weights)
    return tuple(sum(i[c] * w for i, w in zip(items, weights, strict=True)) / total if total else 0.0 for c in range(4))


def describe(box, hist):
    middle = mean([hist[i]["f"] for i in box], [hist[i]["w"] for i in box])
    variance = []
    for c, (share, small) in enumerate(((4, 2), (7, 1), (9, 1), (5, 1))):
        total = 0.0
        for i in box:
            off = (hist[i]["f"][c] - middle[c]) ** 2
            total += hist[i]["w"] * (off / 4 if off < (small / 256) ** 2 else off)
        variance.append(total * share / 16)
    misses = [difference(middle, hist[i]["f"]) for i in box]
    return {"of": box, "mean": middle, "variance": variance, "weight": sum(hist[i]["w"] for i in box), "worst": max(misses), "error": sum(d * hist[i]["p"] for d, i in zip(misses, box, strict=True))}


def cut(hist, size, target, limit):
    boxes = [describe(list(range(len(hist))), hist)]
    while len(boxes) < size:
        now, best, at = limit + len(boxes) / size * 16 * limit, 0, None
        for k, b in enumerate(boxes):
            if len(b["of"]) < 2:
                continue
            s = b["weight"] * max(b["variance"])
            if b["worst"] > now:
                s *= b["worst"] / now
            if s > best:
                best, at = s, k
        if at is None:
            break
        box = boxes[at]
        order = sorted(range(4), key=lambda c: -box["variance"][c])

        def key(i):
            f = hist[i]["f"]
            return -((int(f[order[0]] * 65535) << 16) | int((f[order[2]] + f[order[1]] / 2 + f[order[3]] / 4) * 65535)), i

        line = sorted(box["of"], key=key)
        start = (len(line) - 1) // 2
        centre = line[start : start + (1 if len(line) % 2 else 2)]
        median = mean([hist[i]["f"] for i in centre], [hist[i]["w"] for i in centre])
        share = [math.floor(math.sqrt(difference(median, hist[i]["f"])) * (math.sqrt(1 + hist[i]["w"]) - 1) * 1e9 + 0.5) for i in line]
        run, end = 0, len(line) - 1
        for k, x in enumerate(share):
            run += x
            if 2 * run > sum(share):
                end = min(end, k + 1)
                break
        boxes[at] = describe(line[:end], hist)
        boxes.append(describe(line[end:], hist))
        if sum(b["error"] for b in boxes) <= target * sum(h["p"] for h in hist):
            break
    return boxes


def nearest(f, palette):
    best = min(range(len(palette)), key=lambda k: (difference(f, palette[k]["f"]), k))
    return best, difference(f, palette[best]["f"])


def step(hist, palette, tell=None):
    found = [nearest(h["f"], palette) for h in hist]
    error = sum(d * h["p"] for (_, d), h in zip(found, hist, strict=True)) / sum(h["p"] for h in hist)
    for k, entry in enumerate(palette):
        own = [h for (i, _), h in zip(found, hist, strict=True) if i == k]
        if own and not entry["fixed"]:
            entry["f"], entry["n"] = mean([h["f"] for h in own], [h["p"] for h in own]), sum(h["p"] for h in own)
    if tell:
        for (_, d), h in zip(found, hist, strict=True):
            tell(h, d)
    return error


def search(hist, most, fixed, target, trials, rounds, gain):
    """hist: dicts of f, p, w. The palette as dicts of f, n and fixed, in its final order, and the errors of the search."""
    least, kept, over, errors = 1e20, None, 1.05, []

    def heavier(h, d):
        h["w"] = (h["p"] + h["w"]) * math.sqrt(1 + d)

    while trials > 0:
        boxes = cut(hist, most - len(fixed), target * over, max(45 / 65536, target, least) * 1.2)
        new = [{"f": b["mean"], "n": sum(hist[i]["p"] for i in b["of"]), "fixed": False} for b in boxes] + [{"f": f, "n": 0, "fixed": True} for f in fixed]
        error = step(hist, new, None if kept is None and target > 0 else heavier)
        errors.append(error)
        if kept is None or error < least or (error <= target and len(new) < most):
            kept = new
            if 0 < error < target:
                over = min(over * 1.25, target / error)
            least, most, trials = error, min(len(new) + 1, most), trials - 1
        else:
            for h in hist:
                h["w"] = (h["p"] + h["w"]) / 2
            over, trials = 1.0, trials - (9 if error > 4 * least else 6)
    before = 1e20
    for _ in range(rounds):
        error = step(hist, kept)
        if abs(before - error) < gain:
            break
        before = error
    return sorted((e for e in kept if not e["fixed"]), key=lambda e: -e["n"]) + [e for e in kept if e["fixed"]], errors


def diffuse(image, palette, level, most):
    """image: rows of floats; level: rows of shares; palette: floats. Rows of indices, zig-zag."""
    h, w = len(image), len(image[0])
    rest = [[[0.0] * 4 for _ in range(w)] for _ in range(h + 1)]
    out = [[0] * w for _ in range(h)]
    for y in range(h):
        forward = y % 2 == 0
        for x in range(w) if forward else reversed(range(w)):
            p, s = image[y][x], [e * level[y][x] for e in rest[y][x]]
            ratio = 1.0
            for c in (1, 2, 3):
                if p[c] + s[c] > 1.1:
                    ratio = min(ratio, (1.1 - p[c]) / s[c])
                elif p[c] + s[c] < -0.1:
                    ratio = min(ratio, (-0.1 - p[c]) / s[c])
            size = sum(e * e for e in s)
            if size > most:
                ratio *= 0.8
            want = (min(1.0, max(0.0, p[0] + s[0])), *(p[c] + s[c] * ratio for c in (1, 2, 3)))
            if size <= most and size < 2 / 65536:
                want = tuple(p)
            k = min(range(len(palette)), key=lambda k: (difference(want, palette[k]), k))
            out[y][x] = k
            miss = [a - b for a, b in zip(want, palette[k], strict=True)]
            if sum(e * e for e in miss) > most:
                miss = [e * 0.75 for e in miss]
            on = 1 if forward else -1
            for dx, dy, share in ((on, 0, 7), (on, 1, 1), (0, 1, 5), (-on, 1, 3)):
                if 0 <= x + dx < w:
                    for c in range(4):
                        rest[y + dy][x + dx][c] += miss[c] * share / 16
    return out


def dither_map(idx, edge):
    h, w = len(idx), len(idx[0])
    out = [list(r) for r in edge]
    for y in range(h):
        start, last = 0, idx[y][0]
        for x in range(1, w):
            if idx[y][x] == last and x < w - 1:
                continue
            n = 10 * (x - start) if x > start else 0
            for i in range(start, x):
                n += 15 * sum(1 for z in (y - 1, y + 1) if 0 <= z < h and idx[z][i] == last)
            for i in range(start, x + 1):
                out[y][i] = int((edge[y][i] + 128) * (255 / 383) * (1 - 20 / (20 + n)))
            start, last = x + 1, idx[y][x]
    return out
