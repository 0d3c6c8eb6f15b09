"""Patterns, matches, automata and distances of single lines."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.cli import distance, main
from logweave.functions import graphs, scan
from logweave.functions import patterns as P
from logweave.functions import text as X
from logweave.functions.regex_dfa import compile_dfa

ROUTES = (
    "0.0.0.0         192.168.0.254   0.0.0.0         UG    600    0        0 wlp2s0",
    "192.168.0.0     0.0.0.0         255.255.255.0   U     600    0        0 wlp2s0",
)
FULL = P.PatternSet.full()
FIVE = P.PatternSet.named(["float", "int", "ipv4", "spaces", "uint"])


@pytest.mark.parametrize(
    "name,yes,no",
    [
        ("alnum", ["a", "Z9"], ["", "a b"]), ("any", ["a b\tc", " "], [""]), ("bool", ["0", "1"], ["01", "2"]), ("delimiter", ["--", "###"], ["-+"]),
        ("float", ["1", "-1.5", "+0.25"], ["1.", ".5", "--1"]), ("hexa", ["09afAF"], ["0x1", "g"]), ("int", ["-12", "+3", "4"], ["1.2", "-"]),
        ("ipv4", ["0.0.0.0", "255.255.255.255", "1.02.003.4"], ["256.1.1.1", "1.1.1", "1.1.1.1.1"]), ("ipv6", ["::1", "fe80:1:2::3", "::"], ["1", "g::1", "1:2"]),
        ("letters", ["aZ"], ["a1"]), ("net_ipv4", ["10.0.0.0/8", "1.2.3.4/32"], ["1.2.3.4/33", "1.2.3.4"]), ("net_ipv6", ["::1/128"], ["::1/129"]),
        ("path", ["/a/b-c.d", "/:"], ["a/b", "/"]), ("spaces", [" ", "\t "], ["\n", ""]), ("uint", ["007"], ["-1"]), ("word", ["a-b!", "\n"], ["a b", "é"]),
    ],
)
def test_membership(name, yes, no):
    dfa = FULL.dfas()[name]
    assert all(dfa.accepts(w) for w in yes) and not any(dfa.accepts(w) for w in no)


def test_ranges():
    for regex, top in ((P.UP_TO_32, 32), (P.UP_TO_128, 128), (P.UP_TO_255, 255)):
        dfa = compile_dfa(regex)
        assert [n for n in range(400) if dfa.accepts(str(n))] == list(range(top + 1))


def test_strict_ipv6():
    dfa = compile_dfa(P.ipv6_strict())
    for w in ("1:2:3:4:5:6:7:8", "::", "::1", "1::", "1:2::7:8", "1::3:4:5:6:7:8", "fe80::7:8%eth0", "::255.255.255.255", "::ffff:0:1.2.3.4", "64:ff9b::192.0.2.33"):
        assert dfa.accepts(w), w
    for w in ("1", "1:2", ":::", "1::2::3", "12345::", "1:2:3:4:5:6:7:8:9"):
        assert not dfa.accepts(w), w
    with pytest.raises(ValueError):
        P.ipv6(False, False)


@pytest.mark.parametrize("regex", ["a.b", "^a", "a$", "(a", "a)", "[a", "a{x}", "\\b", "[z-a]", "(?=a)", "*a"])
def test_unknown_syntax(regex):
    with pytest.raises(ValueError):
        compile_dfa(regex)


def test_dialect():
    assert compile_dfa("[^a-c]+").accepts("xyz") and not compile_dfa("[^a-c]+").accepts("xaz")
    assert compile_dfa("(?:ab){2,}").accepts("ababab") and not compile_dfa("(ab){2,}").accepts("ab")
    assert compile_dfa(r"\w+\.\d{1,2}").accepts("a_1.22") and compile_dfa("").accepts("") and not P.empty_dfa().accepts("")
    assert P.any_dfa().accepts("ab") and not P.any_dfa().accepts("a b")


def test_densities():
    known = {"float": 0.053171883656509704, "int": 0.053157894736842064, "ipv4": 9.519316254727908e-13, "spaces": 0.010101010101010102, "uint": 0.05263157894736826, "alnum": 0.449275362318839, "word": 0.9607843127294059}
    assert {n: FULL.densities()[n] for n in known} == pytest.approx(known, rel=1e-12)
    assert P.language_density(P.any_dfa()) == pytest.approx(0.94174757, rel=1e-7)
    assert P.density_vector({"a": 0.1, "c": 0.2, "b": 0.3, "d": 0}) == [0.1, 0.3, 0.2, 0]
    assert P.language_density(compile_dfa("a?"), series=lambda n: 1.0) == pytest.approx(1.01)
    with pytest.raises(ValueError):
        FIVE.with_densities({"int": 1.0}).densities()
    assert "any" in P.PatternSet.named(["int"]).densities()


def test_collections():
    assert P.PatternSet.from_json(FULL.to_json()) == FULL and P.PatternSet.from_json('{"a": "b"}').names == ["a"]
    assert dict(P.PatternSet.default().with_patterns({"int": "1"}).regexes)["int"] == "1"
    with pytest.raises(ValueError, match="'bad'"):
        P.PatternSet.of({"bad": "("}).dfas()


def test_matches_of_addresses():
    got = {n: X.largest("1.2.3.4 5.6.7.8", n, FULL.dfas()[n]) for n in ("int", "ipv4", "float")}
    assert [m[1:] for m in got["int"]] == [(i, i + 1) for i in range(0, 15, 2)]
    assert [m[1:] for m in got["ipv4"]] == [(0, 7), (8, 15)]
    assert [m[1:] for m in got["float"]] == [(0, 3), (2, 5), (4, 7), (8, 11), (10, 13), (12, 15)]


@pytest.mark.parametrize(
    "line,word,number",
    [("!222aaa111zzb", [(0, 13)], []), ("111  zzz 22yy", [(0, 3), (5, 8), (9, 13)], [(0, 3)]), ("  111  zzz 22yy  ", [(2, 5), (7, 10), (11, 15)], [(2, 5)]), ("toto: 3333", [(0, 5), (6, 10)], [(6, 10)])],
)
def test_delimited(line, word, number):
    found = X.delimited(line, P.PatternSet.named(["word", "ipv4", "int", "float", "spaces"]).dfas(), {"spaces"})
    for name, want in (("word", word), ("int", number), ("float", number), ("ipv4", []), ("spaces", [])):
        assert [m[1:] for m in found if m[0] == name] == want
    free = X.delimited("a1 b2", {n: FULL.dfas()[n] for n in ("int", "spaces")}, {"spaces"}, free_left={"int"})
    assert free == [("int", 1, 2), ("int", 4, 5)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="01a.-: /fé\t", max_size=14))
def test_strategies_agree_with_all_matches(line):
    for name, dfa in FULL.dfas().items():
        found = X.all_matches(line, name, dfa)
        assert found == [(name, j, k) for j in range(len(line)) for k in range(j + 1, len(line) + 1) if dfa.accepts(line[j:k])]
        assert X.largest(line, name, dfa) == X.reduce_largest(found)
        assert X.greedy(line, name, dfa) == X.reduce_greedy(found)


def test_automata():
    g = X.automaton(ROUTES[0], FULL)
    assert (len(g.vertices), len(g.arcs)) == (41, 132)
    a, b, c = (X.automaton(w, FIVE) for w in ("11.22.33.44 55.66 789", "55.66.77.88 9876 55.44", "1.2.3.4 77.88 90"))
    assert (len(a.vertices), len(a.arcs)) == (14, 26) and a.signature == c.signature != b.signature
    g = X.automaton("10   abc  1.2.3.4  de 56.78", FIVE)
    assert len({x[:2] for x in g.arcs}) == 22 and len({g.infix(x) for x in g.arcs}) == 18
    empty = X.automaton("", FIVE)
    assert empty.vertices == (0,) and empty.arcs == () and X.automaton("éé", FIVE).to_string() == "0--[any]-->2"
    filtered = X.automaton("10 20", FIVE, filtered=["spaces"])
    assert (2, 3, "any") in filtered.arcs and not any(n == "spaces" for *_, n in filtered.arcs)


def test_any_collision():
    default = P.PatternSet.default()
    over, keep = X.automaton("ab12 foo", default), X.automaton("ab12 foo", P.PatternSet.default(any_collision="keep"))
    assert (0, 2, "any") in over.arcs or over.arcs == keep.arcs
    assert (0, 8, "any") in keep.arcs


def test_cheapest_path():
    cost, path = X.cheapest_path(X.automaton("1.2.3.4 x", P.PatternSet.default()), P.PatternSet.default().densities())
    assert [n for *_, n in path] == ["ipv4", "spaces", "word"] and cost == pytest.approx(0.970885322739)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcé", max_size=20), st.text(alphabet="abcé", max_size=20))
def test_lcs(a, b):
    assert X.lcs_length(a, b) == slow_lcs(a, b) and X.lcs_distance(a, b) == len(a) + len(b) - 2 * slow_lcs(a, b)


def slow_distance(g1, g2, densities):
    """Over all pairs of vertices in order, without a bound."""
    d = {(0, 0): 0.0}
    for u in g1.vertices:
        for v in g2.vertices:
            if (at := d.get((u, v))) is None:
                continue
            steps = [((x, v), x - u) for x in g1.moves[u].values()] + [((u, y), y - v) for y in g2.moves[v].values()]
            steps += [((x, g2.moves[v][n]), slow_distance.lcs(g1.word[u:x], g2.word[v : g2.moves[v][n]]) * densities[n]) for n, x in g1.moves[u].items() if n in g2.moves[v]]
            for to, cost in steps:
                d[to] = min(d.get(to, 1e99), at + cost)
    return d[len(g1.word), len(g2.word)]


slow_distance.lcs = lambda a, b: len(a) + len(b) - 2 * slow_lcs(a, b)


def test_distances():
    default = P.PatternSet.default()
    assert distance(*ROUTES, default, normalized=True) == 0.007259624900493844
    assert distance("", "", default) == 0.0 and distance("", "", default, normalized=True) is None
    draw = random.Random(4)
    lines = ["".join(draw.choice("01a. -é") for _ in range(draw.randrange(0, 12))) for _ in range(25)]
    graphs = [X.automaton(x, default) for x in lines]
    for a in graphs:
        for b in graphs[:8]:
            want = slow_distance(a, b, default.densities())
            assert X.pattern_distance(a, b, default.densities()) == want
            assert X.pattern_distance(a, b, default.densities(), want) is None
            assert X.pattern_distance(a, b, default.densities(), want + 1e-6) == want


def test_commands(capsys, tmp_path):
    assert main(["distance", "-n", *ROUTES]) == 0 and capsys.readouterr().out.strip() == "0.007259624900493844"
    assert main(["mkconf"]) == 0
    import json

    assert json.loads(capsys.readouterr().out).keys() == {"threshold", "patterns"}


def test_batches_equal_single_lines():
    draw = random.Random(3)
    lines = ["".join(draw.choice("abz019.:-+/ \t\n\r@=#~Fé漢🙂") for _ in range(draw.randrange(30))) for _ in range(400)]
    lines += ["1.2.3.4 5.6.7.256/33", None, "", "10.0.0.1/24 ::1/128 fe80::1", "a\0b", "1" * 5000]
    for patterns in (FULL, P.PatternSet.default(any_collision="keep"), P.PatternSet.named(["int", "spaces", "float"])):
        dfas = patterns.dfas()
        for strategy in ("largest", "greedy", "all"):
            some = lines if strategy != "all" else lines[:-1]
            single = [sorted(m for n, d in dfas.items() for m in X.STRATEGIES[strategy](line or "", n, d)) for line in some]
            assert [sorted(found) for found in scan.by_line(some, dfas, strategy)] == single
            for filtered in ((), ("spaces", "hexa", "any")):
                own = [X.automaton(line or "", patterns, dfas, strategy, filtered) for line in some]
                many = graphs.graphs(some, patterns, dfas, strategy, filtered)
                assert many.automata() == own
                assert [(v, a) for v, a in zip(*(c.tolist() for c in many.counts()))] == [(len(g.vertices), len(g.arcs)) for g in own]
                both = set(zip(many.signatures(), (g.signature for g in own)))
                assert len(both) == len({a for a, _ in both}) == len({b for _, b in both})
