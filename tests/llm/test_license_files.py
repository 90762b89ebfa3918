"""Files with several licences: every one must be found, however common it is in the corpus; labels and scores against brute force."""

import math
import random
from collections import Counter

from palimpsest.llm import license_scan


def brute(texts):
    """labels and score of each text, from the rule as it is stated."""
    words = [t.split() for t in texts]
    vocabulary = set(license_scan.licence_words())
    files = Counter(w for ws in words for w in set(ws) & vocabulary)
    out = []
    for ws in words:
        has, labels, best = set(ws), set(), 0.0
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            if any(ws[i : i + len(p)] == p for i in range(len(ws))):
                labels.add(label)
                best = best or None
        shares = []
        for label, t, phrases in license_scan.TEMPLATES:
            tw = t.split()
            if not all(set(p.split()) <= has for p in phrases):
                continue
            mine = sorted(set(tw) & has, key=lambda w: (files[w], w))
            look = set(mine[: max(8, math.ceil(len(mine) * 0.7))])
            posts = [(w, o) for o, w in enumerate(tw) if w in look]
            votes = Counter(p - o for p, w in enumerate(ws) if w in look for x, o in posts if x == w)
            for begin, agree in votes.items():
                ok = agree >= license_scan.AGREE and agree / len(posts) >= license_scan.SHARE
                for p in phrases:
                    pw = p.split()
                    o = begin + next(i for i in range(len(tw)) if tw[i : i + len(pw)] == pw)
                    ok = ok and o >= 0 and ws[o : o + len(pw)] == pw
                if ok:
                    labels.add(label)
                    shares.append(agree / len(posts))
        base = any(label in labels for label in license_scan.BASE.values())
        out.append((",".join(sorted(labels)), max(shares) if shares else 1.0 if base else 0.0))
    return out


def test_labels_and_scores_like_brute_force(spark):
    r = random.Random(3)
    vocabulary = license_scan.licence_words()
    sentences = [t for _, t, _ in license_scan.TEMPLATES]
    texts = ["", "cc by", "all rights reserved", " ".join(vocabulary)]
    for i in range(120):
        parts = []
        for t in r.sample(sentences, r.randint(0, 4)):
            w = t.split()
            for _ in range(r.choice([0, 0, 0, 1, 3])):  # words changed or left out
                j = r.randrange(len(w))
                w[j : j + 1] = r.choice([[], ["changed"], [r.choice(vocabulary)]])
            parts += [*w, *(r.choice([*vocabulary, "prose", "more"]) for _ in range(r.randint(0, 20)))]
        texts.append(" ".join(parts))
    texts += texts[5:9]  # repeated rows
    out = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    got = {r.doc_id: (r.labels, r.score) for r in out}
    want = brute(texts)
    assert len(out) == len(texts) and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-12 for i in range(len(texts)))


def test_every_planted_licence_is_found(spark):
    """Texts of several whole templates, with prose between: recall 1, however common a licence is."""
    r = random.Random(5)
    by = [(label, t) for label, t, _ in license_scan.TEMPLATES]
    planted = [r.sample(by, r.randint(1, len(by))) for _ in range(40)]
    texts = [" prose ".join(t for _, t in p) for p in planted] + [" and ".join(t for _, t in by)] + [by[2][1]] * 200
    got = {r.doc_id: set(r.labels.split(",")) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all({label for label, _ in p} <= got[i] for i, p in enumerate(planted))
    assert {label for label, _ in by} <= got[40] and got[41] == {"mit"}
