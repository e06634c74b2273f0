from __future__ import annotations

import pytest

from stacklore.llm import markup


def elements(text):
    return markup.clean([text])[0][1]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("# Title\n\nText of it.", {"heading"}),
        ("Title of this\n=====\n\nText.", {"heading"}),
        ("=== Wiki head ===\nText.", {"heading"}),
        ("\\subsection*{Name}\nText.", {"heading"}),
        ("<h3 class='x'>Name</h3>", {"heading"}),
        ("Text.\n\n- one\n- two", {"list"}),
        ("* one", {"list"}),
        ("1. one\n2. two", {"list"}),
        ("\\begin{itemize}\n\\item one\n\\end{itemize}", {"list"}),
        ("<ol><li>one</li></ol>", {"list"}),
        ("```sh\n# no heading\n- no item\n```", {"code"}),
        ("Text.\n\n~~~\nx = [1](2)", {"code"}),
        ("<pre><code>a &lt; b</code></pre>", {"code"}),
        ("<pre>cut off", {"code"}),
        ("<syntaxhighlight lang='x'>\n| a |\n</syntaxhighlight>", {"code"}),
        ("\\begin{verbatim}\n\\section{x}\n\\end{verbatim}", {"code"}),
        ("Where $x^2 + 1$ holds.", {"formula"}),
        ("$$ \\sum_i x_i $$", {"formula"}),
        ("\\( a \\) and \\[ b \\]", {"formula"}),
        ("\\begin{equation}\nx_1\n\\end{equation}", {"formula"}),
        ("<math><mi>x</mi></math>", {"formula"}),
        ("| a | b |\n|---|---|\n| 1 | 2 |", {"table"}),
        ("{| class='x'\n|-\n| a || b\n|}", {"table"}),
        ("\\begin{tabular}{ll}\na & b \\\\\n\\end{tabular}", {"table"}),
        ("<table><tr><td>a</td></tr></table>", {"table"}),
        ("See [it](https://a.example/x_y_z).", {"link"}),
        ("See [it][r].\n\n[r]: https://a.example", {"link"}),
        ("![x](https://a.example/p.png)", {"link"}),
        ("[[Page|it]] and [https://a.example it]", {"link"}),
        ("\\href{https://a.example}{it}", {"link"}),
        ("<a href='x'>it</a> <img src='y'>", {"link"}),
        ("Some **bold words** here.", {"inline"}),
        ("Some *words* here.", {"inline"}),
        ("Some _words here_ now.", {"inline"}),
        ("Some ~~words~~ `code` here.", {"inline"}),
        ("Some '''bold''' ''words'' here.", {"inline"}),
        ("Some {{note|words}} here.", {"inline"}),
        ("Some \\textbf{words} here.", {"inline"}),
        ("<p>Text</p><br/>", {"inline"}),
        ("<!-- note -->\nText &copy; us", {"inline"}),
        ("More at https://a.example/x if you like.", set()),
        ("The plan is $5 or $7. Match *.log and *.tmp, then 2 * 3 * 4. C:\\temp\\x, old_a_name, row[0] (not row(0)).", set()),
        ("If a == b, 42 % of R&D, 4 < x and y > 5; {x, y} and (a | b).", set()),
        ("Escaped \\*stars\\* and \\_lines\\_ stay.", set()),
        ("The layout is:\n├── a\n│   └── b", set()),
        ("", set()),
        (None, set()),
        ("  \n\t\n", set()),
    ],
)
def test_elements(text, expected):
    assert elements(text) == expected


def test_readable_text_keeps_structure():
    text = "<h2>Name</h2>\n\nSome **bold** [link](https://a.example) &amp; $x$ text.\n\n* one\n** two\n\n```py\nx = '**a**'\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n$$ y $$"
    assert markup.clean([text])[0][0] == "## Name\n\nSome bold link & $x$ text.\n\n- one\n- two\n\n```\nx = '**a**'\n```\n\na | b\n1 | 2\n\n$y$"


def test_clean_text_stays_as_it_is():
    text = "Plain words, in a paragraph.\n\nAnother one: 2 * 3 = 6, a_b_c."
    assert markup.clean([text])[0] == (text, set())
    once = markup.clean(["# A\n\n- b\n\n```\nc\n```"])[0][0]
    assert markup.clean([once])[0][0] == once


def test_nothing_of_long_texts_is_lost():
    text = "\n\n".join(f"Paragraph number{i} with some words." for i in range(20_000))
    assert markup.clean([text])[0][0] == text
    assert elements("word " * 200_000 + "**x**") == {"inline"}


# Lines that the tree was not trained on, with the kind they have.
HELD_OUT = """h|## A heading of five words
h|###### Deep
x|Sentence without any mark, but with quite a number of words that run on and on to the end.
l|- an item that goes on for longer than the ones that were trained, by quite some words in all
l|+ plus
l|12. twelfth
t|| x | y | z |
t||:---|:--|
x|**Bold** start of a line
k|[Link](https://b.example) start of a line
h|<h4>Small head</h4>
l|<li>item</li>
t|<td>cell</td>
x|<p align="left">Paragraph</p>
h|==== Deep wiki ====
t||- style="x"
l|\\item[x] described
h|\\paragraph{Name}
x|2 * 3 is six
x|One"""


def test_held_out_lines():
    lines = [r.split("|", 1) for r in HELD_OUT.split("\n")]
    right = 0
    for label, line in lines:
        blocks = markup._lines(f"Some words before.\n\n{line}\n\nSome words after.")
        right += markup.classifier().predict(markup._features(blocks))[1] == label
    assert right >= 0.95 * len(lines)


def test_operator(spark):
    df = spark.createDataFrame([(1, "# A", "clash"), (2, None, "x"), (3, "", "y"), (1, "# A", "clash")], "id bigint, text string, clean string")
    got = sorted((r["id"], r["clean"], r["elements"]) for r in markup.clean_markup(df).collect() if r["id"] != 2)
    assert got == [(1, "# A", ["heading"]), (1, "# A", ["heading"]), (3, "", [])]
    assert markup.clean_markup(df).filter("id = 2").first()["clean"] is None


@pytest.mark.parametrize("mark", ["\\[ ", "\\( ", "''a ", "__a ", "**a ", "[[", "<!--", "`a", "{{", "<p ", "\\begin{equation}", "$$ ", "![", "~~a "])
def test_unclosed_marks_do_not_take_quadratic_time(mark):
    import time

    began = time.process_time()
    markup.clean([mark * 20_000])
    assert time.process_time() - began < 2


def test_the_tree_rests_on_words_and_link_density_of_a_block_and_its_neighbours():
    used = {markup.FEATURES[f] for f, *_ in markup.classifier().nodes if 0 <= f < len(markup.FEATURES)}
    assert {"words", "density"} <= used and used & {"density before", "density after"} and used & {"words before", "words after", "blank after", "same mark before"}
    page = "Words that tell of [it](https://a.example/1) at length and go on.\n\n[a](https://a.example/2) [b](https://a.example/3)\n[c](https://a.example/4)\n\nPlain words at the end of it."
    rows = markup._features(markup._lines(page))
    assert markup.classifier().predict(rows).tolist() == ["k", "b", "b", "x"]
    rows[:, [markup.FEATURES.index(f) for f in ("density", "density before", "density after")]] = 0
    assert set(markup.classifier().predict(rows)) == {"x"}


def test_link_density_of_lines():
    text = "no link\n[a](b) and more\n<a\nhref='x'>y</a>\n" + "word " * 5000 + "[a](b)"
    blocks = markup._lines(text)
    assert [b.density > 0 for b in blocks] == [False, True, True, True, True]
    assert blocks[1].density == 6 / 15
    assert markup.clean([text])[0][1] >= {"link"}
