"""Profile matching vs a brute-force statement of the tier rules (counts and sample validity)."""

import random

from parley.operators import match as mt

STD = set(mt.STANDARD_CONCERNS)


def brute_matches(profiles):
    out = {}
    for t in profiles:
        others = [o for o in profiles if o[0] != t[0]]
        a = lambda o: o[1] is not None and t[1] is not None and abs(o[1] - t[1]) <= 3
        s = lambda o: o[2] is not None and t[2] is not None and o[2] == t[2]
        c = lambda o: o[3] is not None and t[3] is not None and o[3] == t[3]
        unknown = t[2] in ("unspecified", "unknown", None)
        if t[3] not in STD:
            f = s if t[1] is None else (a if unknown else (lambda o: a(o) and s(o)))
        elif t[1] is None and unknown:
            f = c
        elif unknown:
            f = lambda o: c(o) and a(o)
        elif t[1] is None:
            f = lambda o: c(o) and s(o)
        else:
            f = lambda o: a(o) and s(o) and c(o)
        m = [o[0] for o in others if f(o)]
        if len(m) < 5:
            m = [o[0] for o in others if a(o) and s(o) and c(o)]
        if len(m) < 5:
            m = [o[0] for o in others if c(o)]
        out[t[0]] = set(m)
    return out


def test_match_profiles_against_brute_force(spark):
    rnd = random.Random(3)
    concerns = ["Anxiety", "Depression", "Grief", None]
    sexes = ["female", "male", "unknown", None]
    profiles = [(f"u{i}", None if rnd.random() < 0.15 else float(rnd.randint(18, 40)), rnd.choice(sexes), rnd.choice(concerns))
                for i in range(160)]
    df = spark.createDataFrame(profiles, "uid string, age double, sex string, concern string")
    exp = brute_matches(profiles)
    # tiny bucket size: every slot is ranked through several salted buckets
    out = mt.match_profiles(df, seed=5, bucket_size=3, checkpoint=False).collect()
    got_n, got_m = {}, {}
    for r in out:
        got_n[r.uid] = r.n_matches
        if r.match_uid is not None:
            got_m.setdefault(r.uid, []).append(r.match_uid)
    for uid, m in exp.items():
        assert got_n[uid] == len(m), uid
        picked = got_m.get(uid, [])
        assert len(picked) == min(5, len(m)) and len(set(picked)) == len(picked) and set(picked) <= m
