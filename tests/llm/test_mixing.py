import hashlib
import re
from collections import defaultdict

from corvine.llm.mixing import MixPlan, mix


def fill(budget, children):
    """children: name -> (weight, capacity). Raise the level until the budget is spent."""
    left, got, open_ = budget, {}, dict(children)
    while open_:
        level = left / sum(w for w, _ in open_.values())
        full = {n for n, (w, c) in open_.items() if c <= w * level}
        if not full:
            return got | {n: w * level for n, (w, _) in open_.items()}
        for n in full:
            got[n] = open_.pop(n)[1]
            left -= got[n]
        left = max(left, 0.0)
    return got


def brute(rows, plan):
    """rows: (doc_id, lang, source, text). Returns doc_id -> copies, by walking the tree."""
    leaves = defaultdict(list)
    for d, lang, source, text in rows:
        domain = next((k for k, v in plan.domains.items() if source in v), "other")
        leaves[domain, lang or "", source or ""].append((d, len(re.findall(r"[^ \t\n\r\f\x0b]+", text or ""))))
    tokens = {k: sum(t for _, t in v) for k, v in leaves.items()}

    def weight(level, name):
        return plan.weights[level].get(name, plan.other[level])

    def split(prefix, budget):
        level = len(prefix)
        if level == 3:
            return {prefix: budget}
        names = {k[level] for k in leaves if k[:level] == prefix}
        caps = {n: (weight(level, n), plan.max_epochs * sum(t for k, t in tokens.items() if k[: level + 1] == (*prefix, n))) for n in names}
        out = {}
        for n, b in fill(budget, caps).items():
            out |= split((*prefix, n), b)
        return out

    copies = {}
    for leaf, budget in split((), plan.share * sum(tokens.values())).items():
        whole = int(budget + 1e-6)
        epochs = min(plan.max_epochs, whole // tokens[leaf]) if tokens[leaf] else 0
        rest = whole - epochs * tokens[leaf]
        place = lambda d: hashlib.md5(f"{plan.seed}:{epochs + 1}:{'' if d is None else d}".encode()).hexdigest()  # noqa: B023, E731
        by_place = defaultdict(int)
        for d, t in leaves[leaf]:
            by_place[place(d)] += t
        cum, taken = 0, set()
        for p in sorted(by_place):
            cum += by_place[p]
            if cum <= rest:
                taken.add(p)
        for d, _ in leaves[leaf]:
            n = epochs + (epochs < plan.max_epochs and place(d) in taken)
            if n:
                copies[d] = n
    return copies


def check(spark, rows, plan):
    df = spark.createDataFrame([(*r, "d", "t", 5, 7) for r in rows], "doc_id long, lang string, source string, text string, domain string, tokens string, copies int, budget int")
    out = mix(df, plan)
    assert out.columns == ["doc_id", "lang", "source", "text", "domain", "tokens", "budget", "copies"]
    got = out.collect()
    assert {r.doc_id: r.copies for r in got} == brute(rows, plan)
    return got


def test_shortages_go_to_siblings_first(spark):
    rows = [(i, "en" if i % 3 else "fr", "src0" if i % 2 else f"src{i % 23}", "w " * (i % 17 + 1)) for i in range(400)]
    rows += [(1000 + i, None, None, None if i % 2 else "a b") for i in range(6)] + [(5, "en", "src0", "w " * 6)] * 2
    for plan in (MixPlan(), MixPlan(share=1.6), MixPlan(share=0.1), MixPlan(share=2.0, max_epochs=2), MixPlan(share=1.0, max_epochs=3, seed=1)):
        check(spark, rows, plan)


def test_one_leaf_holds_all(spark):
    check(spark, [(i, "en", "src0", "x y z") for i in range(3000)], MixPlan(share=0.33))


def test_texts_without_tokens_and_empty_table(spark):
    check(spark, [(1, "en", "src1", ""), (2, "en", "src1", None)], MixPlan())
    assert mix(spark.createDataFrame([], "doc_id long, lang string, source string, text string")).count() == 0
