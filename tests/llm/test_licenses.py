import random
import re

import pytest

from attestor.llm import licenses as L


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for i in range(len(words)) for p, label in L.BASE.items() if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_base_phrases():
    s = L.Scanner(L.BASE, L.TEMPLATES)
    for text in ["CC-BY cc_by ccby. CC BY", "All rights\nreserved! all rights reserved", "éall rights reserved", "GNU General Public License general-public license", "", None, "x" * 5000, "cc by by cc by", "cc byé"]:
        assert s.scan(text)[:5] == brute(text), text


def test_markup():
    a = L.Automaton([("t", 'grant <<beginOptional>>full <<beginOptional>>and free<<endOptional>><<endOptional>> use by <<var;name="who";match=".{1,3}">> only')])
    words = lambda t: L.words(t)
    accepts = lambda t: [(x, y) for _, x, y in a.matches(words(t))]
    assert accepts("Grant use by me only") == [(0, 5)]
    assert accepts("we grant, full and free, use by a b c only!") == [(1, 11)]
    assert accepts("grant full use by x only") == [(0, 6)]
    for wrong in ["grant and free use by x only", "grant use by only", "grant use by a b c d only", "grants use by x only"]:
        assert accepts(wrong) == []
    for bad in ["a <<beginOptional>> b", "a <<endOptional>>", "<<beginOptional>>a<<endOptional>>", 'a <<var;match="x">>']:
        with pytest.raises(ValueError):
            L.Automaton([("t", bad)])
    led = L.Scanner({}, [("t", "<<beginOptional>>this is<<endOptional>> free ware")])
    assert led.scan("this is free ware")[5] == led.scan("now free ware")[5] == "t" and led.scan("this is ware")[5] == ""


def test_templates_are_found():
    s = L.Scanner(L.BASE, L.TEMPLATES)
    label = lambda t: s.scan(t)[5]
    assert label("Text.\nReleased under the MIT License.") == "mit"
    assert label("Licensed under the Apache License, Version 2.0.") == "apache-2.0"
    assert label("This work is licensed under the GNU General Public License, version 3.") == "gpl,gpl-3.0"
    assert label("Licensed under CC BY-NC 4.0.") == "cc-by,cc-by-nc-4.0"
    assert label("Copyright (c) 2020 Some Body. All rights reserved.") == "all-rights-reserved,copyright,reserved"
    assert label("licensed under the mitt license") == ""


def test_odd_rows(odd, none):
    rows = L.scan(odd).collect()
    assert len(rows) == odd.count() and all(r.n_words == 0 and r.labels == "" and r.score == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert L.scan(none).count() == 0


def accepted(template, tokens):
    """By brute force: every way to leave out optional regions and to fill
    replaceable ones, at every start; the longest for each start."""
    parts = re.split(r"(<<.*?>>)", template)

    def parse(at, closed):
        tree = []
        while at < len(parts):
            p = parts[at]
            if p == "<<beginOptional>>":
                inner, at = parse(at + 1, True)
                tree.append(("optional", inner))
            elif p == "<<endOptional>>":
                assert closed
                return tree, at
            elif p.startswith("<<var"):
                tree.append(("any", tuple(map(int, re.search(r"\.\{(\d+),(\d+)\}", p).groups()))))
            else:
                tree += [("word", w) for w in L.words(p)]
            at += 1
        return tree, at

    def ends(tree, at):
        if not tree:
            return {at}
        (kind, what), rest = tree[0], tree[1:]
        if kind == "word":
            return ends(rest, at + 1) if at < len(tokens) and tokens[at] == what else set()
        if kind == "optional":
            return {e for mid in ends(what, at) for e in ends(rest, mid)} | ends(rest, at)
        return {e for n in range(what[0], what[1] + 1) if at + n <= len(tokens) for e in ends(rest, at + n)}

    tree = parse(0, False)[0]
    return [(at, max(found)) for at in range(len(tokens)) if (found := ends(tree, at))]


def test_templates_match_brute_force():
    r = random.Random(30)
    for _ in range(300):
        def region(depth):
            out = []
            for _ in range(r.randrange(1, 4)):
                kind = r.random()
                if kind < 0.6 or depth > 2:
                    out.append(r.choice("abc"))
                elif kind < 0.8:
                    out.append(f"<<beginOptional>>{region(depth + 1)}<<endOptional>>")
                else:
                    least = r.randrange(3)
                    out.append(f'<<var;name="n";match=".{{{least},{least + r.randrange(3)}}}">>')
            return " ".join(out)

        template = "a " + region(0)
        tokens = [r.choice([b"a", b"b", b"c", b"d"]) for _ in range(r.randrange(14))]
        assert [(x, y) for _, x, y in L.Automaton([("t", template)]).matches(tokens)] == accepted(template, tokens), (template, tokens)


def test_production_templates_match_brute_force():
    r = random.Random(31)
    a = L.Automaton(L.TEMPLATES)
    for label, template in L.TEMPLATES:
        whole = re.sub(r"<<var.*?>>", "some body", template)
        texts = [re.sub("<<(begin|end)Optional>>", " ", whole), re.sub("<<beginOptional>>.*?<<endOptional>>", " ", whole)]
        for text in texts:
            tokens = [b"x", *L.words(text), b"y"]
            found = a.matches(tokens)
            assert {(x, y) for l, x, y in found if l == label} >= set(accepted(template, tokens)) and any(l == label for l, _, _ in found)
            del tokens[r.randrange(1, len(tokens) - 1)]  # a word of it is gone
            mine = L.Automaton([(label, template)]).matches(tokens)
            assert [(x, y) for _, x, y in mine] == accepted(template, tokens)


def test_score_is_the_share_of_license_words():
    s = L.Scanner(L.BASE, L.TEMPLATES)
    assert s.scan("released under the mit license")[6] == 1.0 and s.scan("a b c d all rights reserved x")[6] == 3 / 8
    assert s.scan("nothing of it")[6] == 0.0 == s.scan(None)[6]


def test_many_places_in_proportion_to_the_text():
    import time

    s = L.Scanner(L.BASE, L.TEMPLATES)

    def taken(n):
        began = time.process_time()
        found = s.scan("all rights reserved. " * n)
        assert found[1] == n and found[3] == 3 * (n - 1)
        return time.process_time() - began

    small = max(taken(5_000), 0.02)
    assert taken(20_000) < 16 * small


def test_templates_of_files(spark, tmp_path):
    (tmp_path / "Own-1.0.template.txt").write_text("own words <<beginOptional>>of mine<<endOptional>> here")
    (tmp_path / "other.txt").write_text("other words")
    found = L.read_templates(spark, str(tmp_path))
    assert [label for label, _ in found] == ["other", "own-1.0"]
    assert L.Scanner({}, found).scan("these are own words of mine here")[5] == "own-1.0"
