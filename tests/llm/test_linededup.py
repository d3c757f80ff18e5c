import random

from attestor.llm import linededup as L


def brute(rows, least=L.MIN_WORDS):
    """Every pair of places, the later one not overlapping the earlier: equal
    runs from there with so many words go at the later place."""
    places, gone = [], {}
    for doc, text in sorted(rows):
        lines = [x.strip() for x in text.split("\n")]
        gone[doc] = [False] * len(lines)
        for b, before in enumerate([*places, lines]):
            own = b == len(places)
            for i in range(len(lines)):
                for k in range(i if own else len(before)):
                    n, most = 0, i - k if own else len(before) - k
                    while n < most and i + n < len(lines) and lines[i + n] == before[k + n]:
                        n += 1
                    if sum(len(x.split()) for x in lines[i : i + n]) >= least:
                        gone[doc][i : i + n] = [True] * n
        places.append(lines)
    return {doc: "\n".join(x for x, g in zip(text.split("\n"), gone[doc], strict=True) if not g) for doc, text in rows}


def test_windows_of_equal_runs_elect_equal_grams():
    r = random.Random(1)
    run = [" ".join(r.choice("abcdef") for _ in range(r.randrange(1, 30))) for _ in range(12)]
    a, b = L.windows("\n".join(["x y z"] * 5 + run)), L.windows("\n".join(run + ["other line"] * 9))
    of = lambda w: {(fp, key) for *_, fp, _, key in w}
    assert len(of(a) & of(b)) >= 1 and len({k for _, k in of(a) & of(b)}) == len(L.windows("\n".join(run)))


def test_matches_brute_force(spark, make):
    r = random.Random(2)
    pool = [" ".join(r.choice("abcdef") for _ in range(r.choice((0, 3, 8, 20, 60)))) for _ in range(30)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(25)))) for i in range(60)]
    got = {x.row.doc_id: x.text for x in L.dedup_lines(make([(i, t, "en") for i, t in rows])).collect()}
    assert got == brute(rows)


def test_long_passage_goes_from_later_texts_and_short_ones_stay(make):
    passage, short = " ".join(f"w{i}" for i in range(51)), "a short line"
    got = {x.row.doc_id: x for x in L.dedup_lines(make([(2, f"b\n{passage}\nb\n{short}", "en"), (1, f"a\n{passage}\n{short}", "en"), (3, f"{passage}\n{passage}", "en")])).collect()}
    assert got[1].n_deleted == 0 and got[2].text == f"b\nb\n{short}" and got[3].text == ""
    assert [tuple(s) for s in got[2].deleted] == [(1, 2)]


def test_odd_rows(odd, none):
    rows = L.dedup_lines(odd).collect()
    assert len(rows) == odd.count()
    by = {(x.row.doc_id, x.row.text): x for x in rows}
    assert by[2, None].text is None and by[2, None].n_lines == 0
    assert by[3, ""].text == "" and by[9, "a\n" * 300].n_lines == 301
    assert L.dedup_lines(none).count() == 0


def test_repeated_chunks_match_brute_force(spark, make):
    r = random.Random(5)
    pool = ["", " "] + [" ".join(r.choice("abcdef") for _ in range(r.choice((0, 1, 3, 8, 20, 60)))) for _ in range(12)]
    chunks = [[r.choice(pool) for _ in range(r.randrange(1, 9))] for _ in range(12)]
    rows = [(i, "\n".join(x for _ in range(r.randrange(5)) for x in [*r.choice(chunks), r.choice(pool)])) for i in range(60)]
    got = {x.row.doc_id: x.text for x in L.dedup_lines(make([(i, t, "en") for i, t in rows])).collect()}
    assert got == brute(rows)


def test_runs_that_overlap_themselves_keep_their_first_copy(make):
    ten, other = " ".join(f"w{i}" for i in range(10)), " ".join(f"v{i}" for i in range(30))
    texts = ["\n".join([ten] * 12), "\n".join([ten] * 7), "\n".join([other, ten] * 6), "\n".join(["", ten, other] * 9 + [ten])]
    for text in texts:
        got = L.dedup_lines(make([(1, text, "en")])).first().text
        assert got == brute([(1, text)])[1] and len(got.split()) >= L.MIN_WORDS
    got = {x.row.doc_id: x.text for x in L.dedup_lines(make([(i, t, "en") for i, t in enumerate(texts)])).collect()}
    assert got == brute(list(enumerate(texts))) and got[0] == "\n".join([ten] * 5) and got[1] == ""
    r = random.Random(8)
    pool = [ten, other, "", "short line"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(40)))) for i in range(25)]
    got = {x.row.doc_id: x.text for x in L.dedup_lines(make([(i, t, "en") for i, t in rows])).collect()}
    assert got == brute(rows)


def test_a_passage_in_a_third_of_all_texts(make):
    passage = "\n".join(" ".join(f"p{i}x{j}" for j in range(20)) for i in range(4))
    rows = [(i, f"own {i}\n{passage}\nend {i}" if i % 3 == 0 else f"own {i}\nend {i}") for i in range(600)]
    got = {x.row.doc_id: x.text for x in L.dedup_lines(make([(i, t, "en") for i, t in rows])).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"own {i}\nend {i}" for i in range(1, 600))


def test_op1_deletes_runs_up_to_their_last_line(spark, make, tmp_path):
    words = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    copy = f"{words('a', 60)}\n{words('b', 30)}"
    make([(1, copy, "en"), (2, f"own\n{copy}\nlast", "en"), (3, copy, "en")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in L.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got[1].text == copy and got[2].text == "own\nlast" and got[3].text == "" and got[3].n_deleted == 2
