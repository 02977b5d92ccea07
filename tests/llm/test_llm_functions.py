import base64
import random
import re
from re import _parser as sre

import numpy as np
import pytest

from tessera.llm.boilerplate import boilerplate_lines
from tessera.llm.boosting import Boosted, isotonic
from tessera.llm.near_duplicates import joint_likeness, merge, registers
from tessera.llm.packing import best_fit, plan, reduction
from tessera.llm.reading_level import NAMES, RUN, features
from tessera.llm.residue import _MESSAGES, MESSAGE, NONE, PLACEHOLDER, label, needed, similarity, simhashes, unit
from tessera.llm.shingles import batch_shingles, distinct_shingles, jaccard, mix, shingle_hashes, words
from tessera.llm.split_overlap import WINDOW, chain, winnowed
from tessera.llm.tokens import _TABLE, PATTERN, RANKS, Encoder, chunked, repaired, rolled

WORDS = "plum leek salt jar towel clean wipe shelf kettle broth lid stew oats bread drawer rinse soak dry store chop".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def test_words_and_shingles():
    assert words("Ｆｕｌｌ wídth, x_y ½") == ["full", "wídth", "x", "y", "1", "2"]
    lists = [["a", "b", "c", "d"], ["a"], [], ["b", "c", "d"]]
    values, offsets = batch_shingles(lists, 3)
    assert offsets.tolist() == [0, 2, 2, 2, 3] and values[1] == values[2]
    assert (values[:2] == shingle_hashes(lists[0], 3)).all()
    assert len(distinct_shingles(None, 3)) == len(distinct_shingles("", 3)) == 0 and jaccard(np.array([1]), np.array([])) == 0


@pytest.mark.parametrize("edits", [0, 3, 12])
def test_setsketch_estimates_and_merges(edits):
    rng = random.Random(edits)
    errors = []
    for _ in range(30):
        a = text(rng, 200).split()
        b = list(a)
        for _ in range(edits):
            b[rng.randrange(len(b))] = "edited" + str(rng.randrange(10**6))
        x, y = (np.unique(shingle_hashes(t, 3)) for t in (a, b))
        s, t = (registers(v, np.array([0, len(v)])) for v in (x, y))
        errors.append(joint_likeness(s, t, np.array([float(len(x))]), np.array([float(len(y))]))[0] - jaccard(x, y))
        both = np.unique(np.concatenate([x, y]))
        assert (merge(s, t) == registers(both, np.array([0, len(both)]))).all()
    assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.15


def test_winnowing_guarantee_and_chain():
    rng = np.random.default_rng(1)
    for _ in range(200):
        shared = rng.integers(0, 2**63, WINDOW, dtype=np.uint64)
        a, b = (np.concatenate([rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64), shared, rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64)]) for _ in range(2))
        assert set(a[winnowed(a)].tolist()) & set(b[winnowed(b)].tolist())
    assert len(winnowed(np.empty(0, dtype=np.uint64))) == 0
    w = rng.integers(0, 2**63, 40, dtype=np.uint64)
    assert chain(w, w, 3) == (1.0, 1.0)
    cut = chain(w, np.concatenate([w[:20], rng.integers(0, 2**63, 20, dtype=np.uint64)]), 3)
    assert cut == (0.5, 0.5) and chain(w, w[:0], 3) == (0.0, 0.0)


def test_encoding_equals_the_tokenizer():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    reference = tiktoken.Encoding("reference", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    pieces = [" ", "  ", "\n", "\n\n ", "\t", " ", "　", "don't", "'s", "word", "Wort", "слово", "单词", "😀", "1234", "...", "<|endoftext|>", "x" * 50, " ", "\x1c", "\x85", "é", "�"]
    texts = ["", "a", *("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 120))) for _ in range(400)), "ab " * 5000]
    data = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    chunks, first = Encoder(RANKS).encoded(np.frombuffer(b"".join(data), dtype=np.uint8), offsets)
    for i, t in enumerate(texts):
        assert np.frombuffer(b"".join(chunks[first[i] : first[i + 1]]), dtype=np.int32).tolist() == reference.encode_ordinary(t)


def test_repaired_joins_agree_with_the_whole_text():
    encoder, rng = Encoder(RANKS), np.random.default_rng(5)
    texts = ["Salt the water, don't rush it.  Then\n\nwait 12 minutes! " * 8, "漢字かな交じり文が続く" * 20, "🙂🙂 a  b\t\n c" * 20, "x" * 300, " " * 300, "é" * 99, "a b " * 50]
    for text in texts:
        raw = text.encode()
        places = [i for i in range(1, len(raw)) if raw[i] & 0xC0 != 0x80]
        at = [0, *sorted(rng.choice(places, 12, replace=False).tolist()), len(raw)]
        parts = [np.array(encoder.encode(raw[s:e].decode()), dtype=np.uint32) for s, e in zip(at, at[1:])]
        assert repaired(np.concatenate(parts), np.cumsum(list(map(len, parts)))[:-1], encoder)[0].tolist() == encoder.encode(text)


def test_repaired_joins_of_several_texts():
    encoder, rng = Encoder(RANKS), np.random.default_rng(6)
    texts = ["", "kitchen", "a b", " ", "", "don't", "漢字かな交じり文", "The last one, then.", ""]
    parts, joins, starts, at = [], [], [0], 0
    for text in texts:
        cut = int(rng.integers(0, len(text) + 1))
        for x in (text[:cut], text[cut:]):
            parts += encoder.encode(x)
            joins.append(len(parts))
        starts.append(len(parts))
    ids, starts = repaired(np.array(parts, dtype=np.uint32), np.unique(joins[:-1]), encoder, np.array(starts))
    assert [ids[s:e].tolist() for s, e in zip(starts, starts[1:])] == [encoder.encode(t) for t in texts]


def test_rolled_hash_of_every_window():
    data = np.random.default_rng(7).integers(0, 256, 200).astype(np.uint8)
    for span in (1, 6, 16, 21):
        for i in (0, 7, len(data) - span):
            h = 0
            for x in data[i : i + span].tolist():
                h = ((h << 3 | h >> 29) & 0xFFFFFFFF) ^ int(_TABLE[x])
            assert rolled(data, span)[i] == (h * 2654435761 & 0xFFFFFFFF) >> 16


def test_chunks_depend_on_the_content_of_their_text_alone():
    passage = " ".join(f"word{i * i % 97} tells{i}" for i in range(400)).encode()
    one, two = b"A beginning. " + passage, b"Quite another one, of other length: " + passage
    data = np.frombuffer(one + two, dtype=np.uint8)
    bounds = chunked(data, np.array([0, len(one), len(one + two)])).tolist()
    pieces = [bytes(data[s:e]) for s, e in zip(bounds, bounds[1:])]
    n = sum(b <= len(one) for b in bounds) - 1
    shared = set(pieces[:n]) & set(pieces[n:])
    assert len(shared) >= 0.7 * n and b"".join(pieces) == one + two
    run = chunked(np.frombuffer(b"z" * 5000, dtype=np.uint8), np.array([0, 5000]))
    assert len(run) <= 3

def least_bins(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= capacity:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_packing_against_brute_force():
    rng = random.Random(2)
    worse = 0
    for _ in range(400):
        capacity = rng.choice([10, 20, 50])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = {s: items.count(s) for s in items}
        containers = plan(counts, capacity)
        placed = {}
        for pattern, times in containers:
            assert times > 0 and sum(s * q for s, q in pattern) <= capacity
            for s, q in pattern:
                placed[s] = placed.get(s, 0) + q * times
        assert placed == counts
        best = least_bins(items, capacity)
        worse += sum(t for _, t in containers) - best
        left = dict(counts)
        fixed = reduction(left, capacity)
        assert sum(t for _, t in fixed) + least_bins(sorted((s for s, n in left.items() for _ in range(n)), reverse=True), capacity) == best
    assert worse <= 4
    assert plan({}, 10) == [] and best_fit({}, 10) == []


def test_boosting_learns_and_calibration_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    y = np.where(x[:, 0] > 0, 2.0, 0.0) + (x[:, 1] > 1)
    model = Boosted(rounds=60).fit(x[:400], y[:400])
    assert np.mean((model.predict(x[400:]) - y[400:]) ** 2) < 0.15 * y.var()
    knots, values = isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert (np.diff(values) > 0).all() and np.interp(2.5, knots, values) == 2.5


def test_reading_features_are_finite():
    x = features(["", " \n", "?!", "One two three. Four, five: six!", "词 语。", "x" * 100_000, "a. " * 50_000])
    assert x.shape == (7, len(NAMES)) and np.isfinite(x).all() and not x[:3].any()
    assert features([]).shape == (0, len(NAMES))


def test_variety_covers_the_whole_text():
    rng = random.Random(6)
    texts = [text(rng, n).replace("1", "").replace("2", ", ") for n in (1, 30, 118, 125, 400)] + ["same " * 500, "same " * 120 + text(rng, 200), "1 " * 300 + "a b a", "1 2"]
    tokens = [[t.lower() if t.isalpha() else None for t in re.findall(r"[^\W\d_]+|\d+|,", x)] for x in texts]
    for got, ts in zip(features(texts)[:, NAMES.index("variety100")], tokens):
        runs = [[t for t in ts[i : i + RUN] if t] for i in range(max(len(ts) - RUN, 0) + 1)]
        ratios = [len(set(r)) / len(r) for r in runs if r] or [0]
        assert abs(got - sum(ratios) / len(ratios)) < 1e-5


@pytest.mark.parametrize(
    "line",
    [
        "Error 404", "404 Not Found", "Please enable JavaScript to view this page.", "Seite nicht gefunden", "Access denied", "Página no encontrada", "Checking your browser before you reach a.example.",
        "Your text goes here. Replace this paragraph.", "Lorem ipsum dolor sit amet, elit culpa magna.", "xxx xxx xxx", "TODO write intro", "Traceback (most recent call last):", 'File "views.py", line 106, in recipe',
        "Warning: include(header.php): failed to open stream: No such file or directory in /srv/x.php on line 3", "504 - the server could not handle your request", "KeyError: 'title'",
    ],
)
def test_messages(line):
    assert label(line) == MESSAGE


@pytest.mark.parametrize(
    "line",
    [
        "The page could not be found.", "404 | This page could not be found.", "The requested page could not be found.", "Le site est fermé pour maintenance", "test. test. test", 'could not"x"page not found',
        "Here begins a b c d e: " + "lorem, ipsum, dolor " * 8,
    ],
)
def test_messages_without_usual_words(line):
    assert label(line) == MESSAGE


def wording(nodes, rng):
    """A string that a parsed pattern matches, of alternatives drawn at random."""
    out = ""
    for op, arg in nodes:
        if op is sre.BRANCH:
            out += wording(rng.choice(arg[1]), rng)
        elif op is sre.SUBPATTERN:
            out += wording(arg[-1], rng)
        elif op is sre.MAX_REPEAT:
            out += "".join(wording(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 1))))
        elif op is sre.LITERAL:
            out += chr(arg)
        elif op is sre.IN:
            out += next((chr(x) for k, x in arg if k is sre.LITERAL), None) or next(c for c in ", 7x" if re.match(pattern_of_class(arg), c))
        elif op in (sre.ANY, sre.NOT_LITERAL):
            out += " "
    return out


def pattern_of_class(arg):
    names = {sre.CATEGORY_WORD: r"\w", sre.CATEGORY_NOT_WORD: r"\W", sre.CATEGORY_DIGIT: r"\d", sre.CATEGORY_SPACE: r"\s", sre.CATEGORY_NOT_SPACE: r"\S"}
    return "[" + "".join("^" if k is sre.NEGATE else names[x] if k is sre.CATEGORY else f"{chr(x[0])}-{chr(x[1])}" if k is sre.RANGE else re.escape(chr(x)) for k, x in arg) + "]"


def test_needed_strings_miss_no_match():
    rng = random.Random(7)
    for pattern in _MESSAGES:
        tried = 0
        for _ in range(400):
            line = wording(sre.parse(pattern), rng)
            if re.search(pattern, line):
                tried += 1
                assert any(s in line for s in needed(pattern)), (pattern, line)
                assert '"' in line or label(line) != NONE, (pattern, line)
        assert tried, pattern


@pytest.mark.parametrize("line", ["By {{ item.0.label }} on Monday", "${title}", "Hello %%NAME%%, thanks", "__TITLE__", "*|DISH|*", "[insert step text here]", "[object Object]", "Total time: NaN minutes.", "&lt;site.name&gt;", "$AUTHOR_NAME$", "{% block dish %} cups", "cut {{ page.hea"])
def test_placeholders(line):
    assert label(line) == PLACEHOLDER


@pytest.mark.parametrize(
    "line",
    [
        "Error 404 is what our house calls a missing sock in the pantry.", 'A note on the toaster said "service unavailable", so we cooked.', "The app of the range hood needs JavaScript in the browser, so we use the buttons.",
        "Page 404 of the household manual covers closet editing.", "Access is denied to anyone under 6 while the paper sack stands open.", 'The carers filed the note under "undefined" until Friday.', "Print a label that says [spinach, Friday] and stick it on.",
        "The recipe card costs $5 and the basket costs $9.", "The template has 45 rows and a blank column for Thursday.", "Old printers filled empty pages with dummy Latin.", "The display may show an error on the toaster.", "", "   ",
    ],
)
def test_real_sentences(line):
    assert label(line) == NONE


def test_units_and_simhashes():
    assert unit("Session 15bbc9432d97 at fennel.example took 12 s") == unit("session 15fbc9432d88 at  other.example took 9 s")
    a, b, c = simhashes([unit("please enable javascript to view this page now"), unit("Please enable JavaScript to view this page  now"), "something else altogether here"])
    assert a == b and bin(int(a) ^ int(c)).count("1") > 3
    assert similarity("a b c", "a b c") == 1.0 and similarity("", "") == 1.0


PAGE = """Menu
Home | Recipes | Shop
How to clean a doormat
Home / Laundry / How to clean a doormat
How to clean a doormat
Rinse the mat well and dry it flat in the hallway.
Ingredients
2 cups millet
leeks, rinsed

Related stories
Care notes for a narrow thermos
Families that sort the post on Sunda Read more
A second paragraph follows here, and it ends properly.
12 comments
Sitemap
© 2019 Hearth. All rights reserved."""


def test_page_lines():
    assert boilerplate_lines(PAGE, ("How to clean a doormat",)) == [1, 2, 3, 4, 11, 12, 13, 15, 16, 17]
    assert boilerplate_lines(PAGE.replace("\n", "\r\n"), ("How to clean a doormat",)) == [1, 2, 3, 4, 11, 12, 13, 15, 16, 17]
    assert boilerplate_lines("", ()) == [] and boilerplate_lines("\n\n", ()) == []
    assert boilerplate_lines("Menu\nHome", ()) == [1, 2]
    assert boilerplate_lines("Menu\nAccess denied\nIncident 7f2d9c8b9f63\nSitemap", ()) == [1, 4]
    assert boilerplate_lines("<p>One sentence stands here.</p>\n<div>Sitemap</div>", ()) == [2]
