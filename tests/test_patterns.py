"""One tree for matching and drawing, against a reader of the tree written in plain Python."""

import random
from collections import Counter

import pytest
from judgelake.operators import generate, validate
from judgelake.operators.patterns import Node, parse


def plain_match(node: Node, data: bytes, at: int = 0) -> bool:
    if node.hi is None or node.hi > 0:
        n = 0
        while at + n < len(data) and data[at + n] in node.choices:
            n += 1
        if n < node.lo:
            return False
        at += n if node.hi is None else min(n, node.hi)
    if node.children:
        return any(plain_match(c, data, at) for c in node.children)
    return at == len(data)


def rows_of(df):
    return {r.text_id: (r.text, r.matched) for r in df.collect()}


PATTERNS = ["[0-9]?1", "mike|john", "-?[1-9][0-9]{0,3}", "id-([ac]|b{2})", "[^0-9]{1,2}x?", "a(b(c|d)|e[fg]{2,3})", r"\(\)\[\]\{\}\*\|",
            "[a-c\\-x]{2,3}", "[-a]{1,2}", "[a-]{1,2}", "[aab]{3}", "x{0}y", "a{2,}", "é{2}", r"[\ a]{1,3}", "((a|b)|c)", "*?", "z{0,1}(a|z)"]


@pytest.mark.parametrize("bad", ["", "a|", "(a", "a)", "(a|b)c", "(ab)?", "[a", "[z-a]", "a{2,1}", "a{}", "a{,3}", "a{x}", "a{1,2,3}", "\\",
                                 "[a|b]", "()", "[(]"])
def test_illegal_patterns(bad):
    with pytest.raises(ValueError):
        parse(bad)


def test_matching_follows_the_tree(spark):
    rng = random.Random(3)
    pool = ["a", "b", "c", "x", "y", "z", "1", "0", "-", "é", "(", ")", "|", " ", "*", "mike", "john", "id-"]
    tokens = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 5))) for _ in range(1500)] + ["", "()[]{}*|", "éé", "aa", "id-bb", "abc", "aefgf"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "text_id long, token string")
    got = validate.validate_pattern(df, {p: p for p in PATTERNS}).collect()
    hits = Counter()
    for r in got:
        assert r.matched == plain_match(parse(r.pattern_id), r.token.encode()), (r.pattern_id, r.token)
        hits[r.pattern_id] += r.matched
    assert len(got) == len(tokens) * len(PATTERNS) and sum(1 for p in PATTERNS if hits[p]) >= len(PATTERNS) - 2


def test_every_drawn_text_matches(spark):
    keys = spark.range(400).withColumnRenamed("id", "text_id")
    for p in ["mike|john", "-?[1-9][0-9]{0,3}", "id-([ac]|b{2})", "[^0-9]{1,2}x?", "a(b(c|d)|e[fg]{2,3})", r"\(\)\[\]\{\}\|", "((a|b)|c)"]:
        got = rows_of(validate.validate_pattern(generate.gen_strings(keys, "text_id", p, 5), {"p": p}, token_col="text"))
        assert len(got) == 400 and all(m for _, m in got.values()), p
        assert all(plain_match(parse(p), t.encode()) for t, _ in got.values())
    for p in ("a*", "b|c+"):
        with pytest.raises(ValueError):
            generate.gen_strings(keys, "text_id", p, 5)


def test_draws_weigh_choices(spark):
    keys = spark.range(6000).withColumnRenamed("id", "text_id")
    got = Counter(r.text for r in generate.gen_strings(keys, "text_id", "[aab](x|y|z){0}".replace("(x|y|z){0}", "(x|y|z)"), 5).collect())
    assert set(got) == {a + b for a in "ab" for b in "xyz"}
    assert 1.8 < sum(n for t, n in got.items() if t[0] == "a") / sum(n for t, n in got.items() if t[0] == "b") < 2.2
    assert max(got[f"a{b}"] for b in "xyz") < 1.2 * min(got[f"a{b}"] for b in "xyz")
    lengths = Counter(len(r.text) for r in generate.gen_strings(keys, "text_id", "a{2,5}", 5).collect())
    assert set(lengths) == {2, 3, 4, 5} and min(lengths.values()) > 1300
