"""Parsers and matchers at their edges: HTML that is no good HTML, many rules on one host, forms of Unicode."""

from __future__ import annotations

import math
import random
import time
import unicodedata

import pytest

pytest.importorskip("panelwright.llm")
from panelwright.llm import htmlblocks, toxicity, urltrie  # noqa: E402


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<svg><svg></svg><text>DRAWING</text></svg><p>a</p>", ["a"]),
        ("<template><template></template>x</template><p>a</p>", ["a"]),
        ("<object><object></object>q</object>r", ["r"]),
        ("<style>a</styles> b</style><p>c</p>", ["c"]),
        ("<div><svg><path><p>a</p><p>b</p></div>", ["a", "b"]),
        ("<div><svg><g></div>text", ["text"]),
        ("<svg><foreignObject><p>no</p></foreignObject></svg>yes", ["yes"]),
        ("<svg><style>p > a</style><title>t</title></svg>u", ["u"]),
        ("<p>R &<b>copy</b> &amp;lt;</p>", ["R &copy &lt;"]),
        ("<p>a<!-->b<!--->c<!-- > -->d</p>", ["abcd"]),
        ("<p title=a\"b>c</p><p title = '>'>d</p><p data-x=\"'\">e</p>", ["c", "d", "e"]),
        ("<p>x <! y", ["x"]),
    ],
)
def test_blocks_are_those_of_a_browser(page, texts):
    assert [b.text for b in htmlblocks.blocks_of(page)] == texts


@pytest.mark.parametrize("part", ["<!", "<a =\"='>", "<a \"'>", "<svg>", "<svg><p>x", "<a ", "<template><script>", '<a =">"=">"=\'', "<!--", "</script", "<svg><title>"])
def test_time_is_linear_in_the_page(part):
    page = part * (1_000_000 // len(part))
    began = time.thread_time()
    htmlblocks.blocks_of(page)
    assert time.thread_time() - began < 4


def _random_rules(n: int, seed: int):
    rng = random.Random(seed)

    def path() -> str:
        return "/" + "".join(rng.choice("aé/") for _ in range(rng.randint(0, 5))) if rng.random() < 0.8 else ""

    def host() -> str:
        return ".".join(rng.choice("xyz") for _ in range(rng.randint(1, 3)))

    rules = [(host(), path(), rng.choice(("allow", "block"))) for _ in range(n)]
    return rules, sorted({(host(), path() + path()) for _ in range(n)})


def _longest(rules, host, path):
    fits = [(a.count("."), len(b), v == "block", a + b, v) for a, b, v in rules if (host == a or host.endswith("." + a)) and path.startswith(b)]
    return max(fits)[3:] if fits else (None, "allow")


def test_rules_by_trie_and_by_join_are_those_of_a_plain_search(spark, monkeypatch):
    rules, urls = _random_rules(1000, 5)
    want = {f"h://{h}{p}": _longest(rules, h, p) for h, p in urls}
    pages = spark.createDataFrame([(u, 1, "r") for u in want], "url string, host long, rule string")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("x", None, "allow"), ("y", "/", None)], "host string, path string, verdict string")
    for most in (urltrie.MOST_ENTRIES, 1):
        monkeypatch.setattr(urltrie, "MOST_ENTRIES", most)
        assert {r.url: (r.rule, r.verdict) for r in urltrie.filter_urls(pages, table).collect()} == want


def test_many_rules_of_one_host_are_searched_by_halves():
    trie = urltrie.Trie([("x.com", f"/page{i}", "block") for i in range(100_000)])
    began = time.thread_time()
    found = [trie.match("x.com", f"/page{i}x/y")[0] for i in range(0, 100_000, 20)]
    assert time.thread_time() - began < 0.5 and found == [f"x.com/page{i}" for i in range(0, 100_000, 20)]


@pytest.mark.parametrize("text", ["you ïdiot", "you ⓘdiot", "you １diot", "you \U0001d422d\u0456o\u200bt", "YOU I\u0307DIO\u0336T", "you 1d10\U000e0101t"])
def test_folding_is_the_same_for_all_forms(text):
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        assert toxicity.fold(unicodedata.normalize(form, text)) == (" you idiot ", 2)


def test_letters_of_all_planes_are_words():
    assert toxicity.fold("𠀀a \U00030001 ﬁne ½") == (" 𠀀a \U00030001 fine i   ", 4)
    assert toxicity.fold("हिन्दी") == (" हिनदी ", 1)


def test_toxicity_of_no_rows_and_of_clashing_columns(spark):
    model = toxicity.Model({"idiot": 3.0})
    docs = spark.createDataFrame([(1, "you ïdiot", 7, "x"), (2, None, None, None)], "doc_id long, text string, score int, weight string")
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert rows[1].weight == 3.0 and rows[1].score > rows[2].score and rows[2].words == 0
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_entries_are_those_of_a_plain_choice():
    """Every number of entries is tried for the rule of false discoveries, and nested beginnings are compared in pairs."""
    rng = random.Random(4)
    for _ in range(60):
        toxic, clean, tests = 40, rng.choice((60, 300)), rng.choice((5, 60, 400))
        counts = {}
        for _ in range(rng.randint(1, 25)):
            n = rng.randint(3, 20)
            counts["".join(rng.choice("ab") for _ in range(rng.randint(3, 6)))] = (rng.randint(n // 2, n), n)
        p = toxic / (toxic + clean)
        chance = {s: sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(a, n + 1)) for s, (a, n) in counts.items()}
        most = max((i for i in range(1, len(counts) + 1) if sorted(chance.values())[i - 1] <= 0.01 * i / tests), default=0)
        left = [s for s, _ in sorted(chance.items(), key=lambda x: (round(math.log(x[1]), 9), -len(x[0]), x[0]))[:most]]
        want: list[str] = []
        while left:
            first = left[0]
            entry = max((s for s in counts if s.startswith(first) and (s == first or counts[s][0] >= 0.95 * counts[first][0])), key=lambda s: (len(s), s))
            want.append(entry)
            left = [s for s in left if not s.startswith(entry) and not entry.startswith(s)]
        assert sorted(toxicity.choose_entries(counts, tests, toxic, clean)) == sorted(want)
