"""Long runs of one thing, which patterns with too much choice would not survive."""

import pytest

from quernstone.llm import abuse, documentation, handwritten, leakage, splitting, syntax

N = 60_000
RUNS = {
    "letters": "a" * N, "slashes": "/" * N, "digits": "1" * N, "quotes": '"' * N, "stars": "* " * N, "backslashes": "\\" * N, "dashes": "- " * N, "angles": "<" * N, "spaced": "x y " * N, "dots": "a.b." * N, "lines": "\n" * N,
    "hashes": "#" * N, "entities": "&" * N, "percents": "%41" * N, "numbers": "1," * N, "blanks": " " * N, "ideographs": "漢" * N, "templates": "`${" * 500, "params": "(a," * 500, "assignments": "a=(" * 500 + "1",
}
LEXICON = abuse.Lexicon(abuse.all_terms())
INDEX = leakage.ItemIndex([(1, " ".join(f"word{i} other{i * 7}" for i in range(40)))])
CLASSIFY = handwritten.make_kernel()


@pytest.mark.parametrize("name", RUNS)
def test_kernels_end(name):
    text = RUNS[name]
    for language in ("javascript", "python", "json", "c"):
        assert syntax.first_error(text, language) is None or syntax.first_error(text, language) >= 1
    assert next(iter(CLASSIFY(1, "r", "src/a.js", text, None)))[0] == 1
    documentation.tells(text, "name", ["a"])
    documentation.documentation_in(text, "js")
    documentation.documentation_in('def f():\n  """' + text, "py")
    assert list(INDEX.bands(leakage.squeezed(text))) == []
    assert max(abuse.passages(text, LEXICON), default=(0.0, None))[0] < abuse.CASE
    pieces = splitting.split(splitting.TextIndex(text), 0, len(text), 2600, 60, 4)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)


def test_nested_ambiguity_is_linear():
    for depth in (50, 400):
        assert syntax.first_error("(a = " * depth + "1" + ")" * depth + ";", "javascript") is None
        assert syntax.first_error("x = " + "[" * depth + "]" * depth + "\n", "python") is None
