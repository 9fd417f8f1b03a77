"""Plain single-loop versions of the order-dependent operators, for comparison."""

import math
import re


def words_of(norm):
    return {w for w in norm.split(" ") if len(w) > 2}


def overlap(a, b):
    if not a or not b:
        return 0.0
    return len(a & b) / len(a | b)


def cosine(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    if not na or not nb:
        return 0.0
    return round(sum(x * y for x, y in zip(a, b)) / (na * nb), 12)


def cluster(rows, threshold=0.45):
    """rows: dicts with ord, publisher, norm, url, embedding. -> {ord: (hub, role, merged)}"""
    hubs, out = [], {}
    for r in sorted(rows, key=lambda x: x["ord"]):
        best, best_sim = None, -1
        for hub in hubs:
            sims = [cosine(r["embedding"], m["embedding"]) for m in hub]
            top, lead = max(sims), sims[0]
            same = r["publisher"].strip() and any(m["publisher"].strip() == r["publisher"].strip() for m in hub)
            if same and (lead < 0.55 or overlap(words_of(r["norm"]), words_of(hub[0]["norm"])) < 0.25):
                continue
            if len(hub) >= 4 and lead < 0.30:
                continue
            if top > best_sim:
                best, best_sim = hub, top
        if best is None or best_sim < threshold:
            hubs.append([r])
            out[r["ord"]] = (r["ord"], "lead", None)
            continue
        twin = None
        for m in best:
            if (r["url"] or "").strip() and (r["url"] or "").strip() == (m["url"] or "").strip():
                twin = m
            elif r["norm"] and m["norm"] and (r["norm"] == m["norm"] or overlap(words_of(r["norm"]), words_of(m["norm"])) >= 0.85):
                twin = m
            if twin:
                break
        if twin:
            out[r["ord"]] = (best[0]["ord"], "duplicate", twin["ord"])
        else:
            best.append(r)
            out[r["ord"]] = (best[0]["ord"], "member", None)
    return out


def is_match(a, b, band):
    if a["url"] and b["url"] and a["url"] == b["url"]:
        return True
    if band is not None and a["at"] is not None and b["at"] is not None and abs(a["at"] - b["at"]) > band:
        return False
    if not b["norm"]:
        return False
    return a["norm"] == b["norm"] or overlap(words_of(a["norm"]), words_of(b["norm"])) >= 0.85


def dedup(aggregator, direct, band=7200, min_title=10):
    """{ord of a dropped aggregator item: ord of the row it repeats}"""
    pool, out = sorted(direct, key=lambda x: x["ord"]), {}
    for a in sorted(aggregator, key=lambda x: x["ord"]):
        hit = None
        if len(a["norm"]) >= min_title:
            hit = next((p for p in pool if is_match(a, p, band)), None)
        if hit is None:
            pool.append(a)
        else:
            out[a["ord"]] = hit["ord"]
    return out


def keep_lines(lines):
    kept, seen = [], []
    for line in lines:
        cut = re.sub(r"\s+-\s+[A-Z][A-Za-z0-9\s.&'-]{2,35}$", "", re.sub(r"\s*\|\s*.*$", "", line))
        key = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9ऀ-ൿ\s]", "", cut.lower())).strip()
        if not key:
            continue
        mine = words_of(key)
        if any(
            p == key or (len(p) > 25 and (key in p or p in key)) or (len(mine) >= 4 and overlap(mine, words_of(p)) >= 0.68)
            for p in seen
        ):
            continue
        seen.append(key)
        kept.append(line)
    return kept


def tokens(t):
    return max(1, math.ceil(len(t) / (2.2 if re.search(r"[ऀ-ൿ]", t) else 3.8))) if t else 0


def chunks(text, limit=420, most=4):
    done, cur, size = [], [], 0
    for s in [x for x in re.split(r"(?<=[.?!])\s+", text) if x]:
        if size + tokens(s) > limit and cur:
            done.append(" ".join(cur))
            cur = [cur[-1], s]
            size = tokens(" ".join(cur))
        else:
            cur.append(s)
            size += tokens(s)
    if cur:
        done.append(" ".join(cur))
    return done[:most]
