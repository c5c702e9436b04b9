import re
from collections import Counter, defaultdict


from periodix.llm import quality as Q


def brute(rows, min_docs, share):
    sep = re.compile(r"[^\x20\x09-\x0D]+")
    rows = list(dict.fromkeys(rows))
    fold = lambda x: " ".join(sep.findall(x)).lower()
    seen, hosts = defaultdict(dict), defaultdict(set)
    for i, t, s in rows:
        hosts[s].add(t)
        for x in (t or "").split("\n"):
            if fold(x):
                k = seen[s, fold(x)]
                k[t] = min(k.get(t, 1 << 62), 1 << 62 if i is None else i)
    bad = {k: min(v, key=lambda t: v[t]) for k, v in seen.items()
           if len(v) > min_docs and 100 * len(v) > share * len(hosts[k[0]])}
    out = {}
    for i, t, s in rows:
        w = sep.findall(t or "")
        grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        n = Counter(grams)
        rep = len({k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)})
        ls = [x for x in (t or "").split("\n") if fold(x)]
        gone = sum(len(sep.findall(x)) for x in ls if bad.get((s, fold(x)), t) != t)
        base = len(w) < 10 or 100 * rep > 20 * len(w)
        kept = not base and len(w) - gone >= 10 and 100 * (len(w) - gone) >= 50 * len(w)
        out[i, t, s] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)),
                        rep, base, kept, gone)
    return out


def test_matches_brute_force(docs_of):
    boiler = "Subscribe  to OUR letter\tnow please"
    rows = []
    for i in range(60):
        body = " ".join(f"w{(i * 31 + k * k) % 97}é" for k in range(8 + i % 23))
        rows.append((i, f"{boiler}\n{body}\n{boiler.lower() if i % 2 else 'end'}\n\n  ", "en", f"h{i % 2}"))
    rows += [(100, "a b c d e " * 9, "en", "h0"), (101, "a b c d e f a b c d e " + " ".join(map(str, range(60)))),
             (102, None), (103, ""), (104, "# * | x"), (105, "x " * 30, "en", None), (106, "one\none\ntwo\none", None, None),
             (None, rows[0][1], "en", "h0"), (3, rows[3][1], "en", rows[3][3]), (200, rows[5][1], "en", rows[5][3])]
    df = docs_of(rows).selectExpr("*", "1 AS n_words", "2 AS kept", "3 AS _id").repartition(5)
    got = Q.line_verdicts(df, min_docs=5, share=5).collect()
    want = brute([(r[0], r[1], r[3] if len(r) > 3 else "src0") for r in rows], 5, 5)
    assert len(got) == len(rows)
    for r in got:
        q = r["quality"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"],
                q["kept"], q["n_removed_words"]) == want[r["doc_id"], r["text"], r["source"]], r
    assert any(q["quality"]["n_removed_words"] for q in got)
    kept = [r["doc_id"] for r in got if r["source"] == "h0" and not r["quality"]["n_removed_words"]]
    assert 0 in kept  # the earliest document keeps its lines


def test_empty(docs_of):
    assert Q.line_verdicts(docs_of([])).count() == 0
