import json
import random

from quernstone.llm import leakage
from quernstone.llm.leakage import ItemIndex, item_words, leaked, leaks

rnd = random.Random(9)
VOCAB = ["".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randrange(2, 10))) for _ in range(600)]


def passage(n):
    return [rnd.choice(VOCAB) for _ in range(n)]


def brute(words, doc_words, least=20, altered=2):
    """Whether a document holds a run of item words with few replaced in place, those at the ends too."""
    for i in range(len(words) - least + 1):
        for j in range(len(doc_words) - least + 1):
            changes = 0
            for k, (a, b) in enumerate(zip(words[i:], doc_words[j:])):
                changes += a != b
                if changes > altered:
                    break
                if k + 1 >= least:
                    return True
    return False


def found(item, text):
    return any(leaked(ItemIndex([(1, item)]), text))


def test_equals_brute_force_for_replaced_words():
    for _ in range(250):
        words = passage(rnd.randrange(20, 60))
        n = rnd.randrange(14, len(words) + 1)
        i = rnd.randrange(len(words) - n + 1)
        part = words[i : i + n]
        for _ in range(rnd.randrange(4)):
            part[rnd.randrange(n)] = rnd.choice(VOCAB) + "zz"
        doc = passage(20) + part + passage(20)
        assert found(" ".join(words), " ".join(doc)) == brute(words, doc), (words, doc)


def test_disguises():
    words = passage(40)
    text = " ".join(words)
    lines = [" ".join(words[i : i + 7]) for i in range(0, 40, 7)]
    for doc in (
        text.upper(), "\n".join("# " + x for x in lines), "\n".join(f"{i + 1}: {x}" for i, x in enumerate(lines)), "<p>" + text.replace(" ", "</b> <b>") + "</p>", json.dumps("\n".join(lines)),
        text.replace(" ", ", "), "> " + "\r\n> ".join(lines), text.replace(" ", "&nbsp;"), "\n".join(f"[12:0{i}] a.b: {x}" for i, x in enumerate(lines)), text.replace(" ", ""),
        " ".join([*words[:9], "extra", *words[9:25]]), " ".join([*words[:9], *words[10:25]]),
    ):
        assert found(text, "before it. " + doc + " after it"), doc


def test_short_quotes_and_templates_are_no_leaks():
    words = passage(60)
    assert not found(" ".join(words), " ".join(passage(30) + words[10:27] + passage(30)))
    assert not found(" ".join(words), " ".join(words[::-1]))
    assert not found(" ".join(words[:19]), " ".join(words))


def test_table(spark):
    words = passage(50)
    items = spark.createDataFrame([(7, "q", " ".join(words)), (8, "q", None), (9, "q", "short one"), (7, "q", " ".join(words))], "item_id long, query string, text string")
    docs = spark.createDataFrame([(1, " ".join(words), "x"), (1, " ".join(words), "x"), (2, None, "x"), (3, "", "x"), (4, "nothing " * 5000, "x"), (None, " ".join(words), "x")], "doc_id long, text string, item_id string")
    assert [(r.doc_id, r.item_id) for r in leaks(docs, items).collect()] == [(1, 7)]
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0
    assert item_words("A-b c_d! é") == ["ab", "cd", "e"]


def edited(words, doc_words, least=20, altered=2):
    """Whether a document holds a run of item words with few replaced, left out or put in; a replaced word may be at an end, the others not."""
    for i in range(len(words) - least + 1):
        for j in range(len(doc_words)):
            todo = [(i, j, 0, False)]
            while todo:
                a, b, used, out = todo.pop()
                while a < len(words) and b < len(doc_words) and words[a] == doc_words[b]:
                    a, b, out = a + 1, b + 1, False
                if a - i >= least and not out:
                    return True
                if used < altered:
                    todo += [(a + 1, b + 1, used + 1, False)] if a < len(words) and b < len(doc_words) else []
                    todo += [(a + 1, b, used + 1, True), (a, b + 1, used + 1, out)] if a > i else []
    return False


def test_short_words_after_alterations():
    short = random.Random(5)
    vocab = ["".join(short.choice("abcdefghijklmnoprstuvw") for _ in range(short.randrange(2, 10))) for _ in range(600)]
    cases = more = 0
    for _ in range(1000):
        words = [short.choice(vocab) for _ in range(short.randrange(20, 40))]
        n = short.randrange(18, min(24, len(words)) + 1)
        i = short.randrange(len(words) - n + 1)
        part = words[i : i + n]
        for k in sorted(short.sample(range(1, n - 1, 2), short.randrange(4)), reverse=True):
            part[k : k + short.randrange(2)] = [short.choice(vocab) + "zz"] * short.randrange(2)
        around = ["".join(short.choice("xyz") for _ in range(short.randrange(2, 10))) for _ in range(20)]
        doc = around[:10] + part + around[10:]
        got, want = any(leaked(ItemIndex([(1, " ".join(words))]), " ".join(doc))), edited(words, doc)
        assert got or not want, (words, doc)
        cases, more = cases + want, more + (got and not want)
    assert 100 < cases < 900 and more < 10


def test_short_word_alone_between_and_after_altered_words():
    words = passage(24)
    words[10], words[19] = "of", "the"
    other = [*words[:9], "first", "of", "second", *words[12:20]]
    closing = [*words[:18], "altered", "the"]
    for part in (other, closing):
        for doc in (" ".join(part), ", ".join(part), "_".join(part)):
            assert any(leaked(ItemIndex([(1, " ".join(words))]), "before it. " + doc + " . after it")), doc
    assert not any(leaked(ItemIndex([(1, " ".join(words))]), " ".join(["x", *words[1:17], "altered", "the", "then"])))


def test_alterations_of_any_length_and_place():
    words = passage(30)
    item = " ".join(words)
    long = "q" * 60
    middle, inserted = [*words[:8], long, *words[9:21]], [*words[:10], long, *words[10:20]]
    first, last, both, left_out = [*words[5:24]], [*words[:19], "other"], ["other", *words[1:19], "other"], [*words[:7], *words[8:12], *words[13:21]]
    huge = [*words[:6], "q" * 900, *words[7:13], "r" * 700, *words[14:20]]
    for part in (middle, inserted, ["other", *first], last, both, left_out, huge, [long, *words[1:19], long]):
        for doc in (" ".join(part), ", ".join(part), "\n> ".join(part)):
            assert any(leaked(ItemIndex([(1, item)]), "before it. " + doc + " . after it")), doc
    assert any(leaked(ItemIndex([(1, item)]), "".join(["before", *middle, "after"])))
    assert not any(leaked(ItemIndex([(1, item)]), " ".join(["before", *words[1:18], "after"])))
    assert not any(leaked(ItemIndex([(1, item)]), " ".join([*words[:8], "x", "y", "z", *words[8:12], *words[13:20]])))


def test_very_short_words():
    letters = "a b c d e f g h i j k l m n o p q r s t u v".split()
    item = " ".join(letters)
    for part in ([*letters[:6], "1", *letters[7:13], "2", *letters[14:]], [*letters[:7], "1", *letters[8:14], "22", *letters[15:21]]):
        assert any(leaked(ItemIndex([(1, item)]), "xx " + " ".join(part) + " yy"))
    assert not any(leaked(ItemIndex([(1, item)]), " ".join([*letters[:6], "1", *letters[7:13], "2", *letters[14:17], "3", *letters[18:]])))


def test_most_words_of_a_passage():
    words = passage(60)
    assert list(leaked(ItemIndex([(1, " ".join(words))]), "x " + " ".join(words[:21]) + " and later y " + " ".join(words[20:58]) + ".")) == [(0, 40)]


def test_join_gives_what_the_broadcast_gives(spark, monkeypatch):
    items = [(i, " ".join(passage(30 + i))) for i in range(12)] + [(90, "a b c d e f g h i j k l m n o p q r s t u v"), (91, "short"), (92, None)]
    docs = []
    for n in range(60):
        words = (items[n % 12][1] if n % 5 else items[12][1]).split()
        i = rnd.randrange(0, max(1, len(words) - 22))
        part = words[i : i + rnd.randrange(15, 24)]
        for _ in range(rnd.randrange(4)):
            part[rnd.randrange(len(part))] = rnd.choice(VOCAB) * rnd.randrange(1, 9)
        docs.append((n, " ".join([*passage(5), *part, *passage(5)])))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = {tuple(r) for r in leaks(a, b).collect()}
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 10)
    assert {tuple(r) for r in leaks(a, b).collect()} == one and 10 < len(one) < 60
