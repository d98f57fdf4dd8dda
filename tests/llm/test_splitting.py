import random

import pytest

from quernstone.llm.splitting import TextIndex, oversized_pieces, split
from tests.conftest import write_tables

CHUNKS = "id long, mode string, repo string, file_id long, file string, start long, `end` long"
FILES = "file_id long, repo string, path string, content string, ingested_at timestamp"
LIMITS = "mode string, max_bytes int, max_lines int, overlap_lines int"


def check(text, start, end, max_bytes, max_lines, overlap):
    index = TextIndex(text)
    pieces = split(index, start, end, max_bytes, max_lines, overlap)
    assert pieces[0][0] == start and pieces[-1][1] == end
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a <= c <= b and b <= d and a < d
    for a, b in pieces:
        piece = text[a:b]
        assert len(piece.encode()) <= max_bytes
        assert (piece[:-1] if piece.endswith("\n") else piece).count("\n") + 1 <= max_lines
    return pieces


def test_random_texts_stay_within_limits_and_are_covered():
    rnd = random.Random(3)
    for _ in range(300):
        alphabet = rnd.choice(["ab \n", "aé漢😀 \n\n", "x\r\n }", "abc"])
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 900)))
        start = rnd.randrange(len(text))
        end = rnd.randrange(start + 1, len(text) + 1)
        check(text, start, end, rnd.randrange(16, 200), rnd.randrange(2, 12), rnd.randrange(0, 4))


def test_neighbours_share_the_overlap_and_cut_at_blank_lines():
    block = "def f():\n    x = 1\n    return x\n\n"
    text = block * 40
    pieces = check(text, 0, len(text), 2000, 30, 2)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert text[c:b].count("\n") == 2
        assert text[b - 2 : b] == "\n\n"


def test_the_whole_overlap_is_shared_where_it_fits():
    text = ("x" * 130 + "\n") * 30
    pieces = check(text, 0, len(text), 512, 60, 2)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert text[c:b].count("\n") == 2 and c < b < d
    rnd = random.Random(4)
    for _ in range(100):
        text = "".join("y" * rnd.randrange(1, 120) + "\n" for _ in range(rnd.randrange(20, 80)))
        most, overlap = rnd.randrange(500, 900), rnd.randrange(1, 5)
        pieces = check(text, 0, len(text), most, rnd.randrange(overlap + 1, 30), overlap)
        for (a, b), (c, d) in zip(pieces, pieces[1:]):
            # fewer lines only where one more and the line that follows do not fit
            shared = text[c:b].count("\n")
            before = text.rfind("\n", 0, c - 1) + 1
            assert shared == overlap or c == 0 or len(text[before : text.find("\n", b) + 1]) > most


def test_indents_of_any_width():
    text = ("a\n" + " " * 400 + "b\n" + " " * 400 + "c\n") * 12
    pieces = check(text, 0, len(text), 4000, 50, 0)
    assert all(text[a] == "a" for a, _ in pieces)


def test_line_of_a_single_huge_line_is_cut_by_bytes():
    text = "é" * 5000
    pieces = check(text, 0, len(text), 999, 10, 3)
    assert len(pieces) >= 11


def test_ranges_and_duplicates(spark, tmp_path):
    text = "line\n" * 100
    ts = None
    folder = write_tables(
        spark, tmp_path,
        chunks=([
            (1, "code", "r", 1, "a.py", 0, 500), (1, "code", "r", 1, "a.py", 0, 500), (2, "code", "r", 1, "a.py", 0, 50), (3, "code", "r", 1, "a.py", 20, 10),
            (4, "code", "r", None, ".\\a.py ", 0, 9999), (5, "none", "r", 1, "a.py", 0, 500), (6, "code", "r", 9, "b.py", 0, 500), (7, "code", "r", 1, "a.py", None, 500),
            (8, "code", "r", 1, "a.py", 600, 700), (9, "code", None, None, None, 0, 500),
        ], CHUNKS),
        files=([(1, "r", "a.py", text, ts), (1, "r", "a.py", text, ts), (2, "r", "e.py", "", ts), (None, "r", "n.py", text, ts), (3, "r", None, None, ts)], FILES),
        chunklimits=([("code", 2600, 60, 4), (None, 1, 1, 1)], LIMITS),
    )
    rows = oversized_pieces(spark, folder).orderBy("id", "piece").collect()
    assert {r.id for r in rows} == {1, 4}
    ones = [r for r in rows if r.id == 1]
    assert ones[0].start == 0 and ones[-1].end == 500 and ones[-1].endLine == 100
    assert [(r.start, r.end) for r in rows if r.id == 4] == [(r.start, r.end) for r in ones]


def test_many_chunks_of_one_file_are_all_split(spark, tmp_path):
    text = "line\n" * 200
    folder = write_tables(
        spark, tmp_path,
        chunks=([(i, "code", "r", 1, "a.py", i % 7, 1000) for i in range(1500)], CHUNKS),
        files=([(1, "r", "a.py", text, None)], FILES), chunklimits=([("code", 2600, 60, 4)], LIMITS))
    assert oversized_pieces(spark, folder).select("id").distinct().count() == 1500


def test_empty_tables(spark, tmp_path):
    folder = write_tables(spark, tmp_path, chunks=([], CHUNKS), files=([], FILES), chunklimits=([], LIMITS))
    assert oversized_pieces(spark, folder).count() == 0


@pytest.mark.parametrize("limit", [4, 7])
def test_tiny_limits(limit):
    check("aé漢😀" * 10, 0, 40, limit, 3, 2)
