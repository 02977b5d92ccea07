"""Template residue and error-page text: trusted labels spread over near-duplicate lines.

A record's text is taken line by line (whole text, distinct lines once). Patterns give trusted labels: messages of error
pages and script notices, filler text, placeholders and unfilled variables; quoted words never count, so sentences that
merely cite a message don't match. Lines equal but for numbers, hexadecimal ids and host names are one unit. Units get a
64-bit SimHash over words and pairs of words, kept in ten tables, each keyed by two of five blocks of the hash, so that
any two hashes within Hamming distance 3 meet in a table. From the units with trusted message labels the links that pass
the Hamming test and a text similarity of 0.8 are followed until no new unit is reached: exactly the connected
components that hold a trusted label. Placeholders label only the lines that hold them, for what surrounds a placeholder
is often a genuine sentence.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations
from re import _parser as sre

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shingles import batch_shingles
from tessera.sources.tables import load, persisted, spread

HAMMING, SIMILARITY = 3, 0.8
NONE, MESSAGE, PLACEHOLDER = 0, 1, 2

# Wordings of error pages, script notices and filler in the languages of the pages.
_STATUS = r"bad request|unauthori[sz]ed|payment required|forbidden|(?:page )?not found|method not allowed|not acceptable|request time-?out|conflict|gone|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|service error"
_MESSAGES = rf"""
^\W*(?:(?:http )?(?:error|status|fehler|erreur|código|code)[ :]*)?[45]\d\d\W+(?:{_STATUS})\b.{{0,40}}$
^\W*(?:http )?(?:error|status|fehler|fehlercode|erreur)(?: code)?[ :]*[45]\d\d\W*$
^\W*(?:{_STATUS})\W*$
\b[45]\d\d - the server\b
\berreur [45]\d\d\b
\bfehlercode[ :]*[45]\d\d\b
\bserver at \S+ could not (?:complete|fulfil|handle|process)
\bserver (?:could not|was unable to) (?:complete|fulfil|handle|process) your request
\bpage (?:could not be|was not|not) found\b
\bseite (?:wurde )?nicht gefunden\b
\b(?:angeforderte|gesuchte) (?:adresse|seite) (?:existiert|wurde)\b
\bp[áa]gina no (?:fue )?encontrada\b
\benlace que seguiste\b
\bpage introuvable\b
\badresse demandée n['’]existe
\bcan(?:['’]t|not) find (?:the|that) page\b
\bthe link is out of date\b
\bthat page has moved\b
\bmoved or never existed\b
\b(?:recipe|page|article|content|video) you (?:asked for|requested|are looking for) (?:is|was|could|has|cannot)\b
\b(?:page|content|article|site) is (?:not|no longer|currently not|temporarily un)\s?available\b
^\W*access denied\b
\bdon['’]t have permission to (?:open|access|view)\b
\btoo many requests from\b
\bslow down and try again\b
\bchecking (?:if )?your (?:browser|connection)\b
\bverify (?:that )?you are (?:a )?human\b
\b(?:site|page|server|we) (?:is|are) (?:currently )?(?:down|offline|closed) for (?:scheduled )?maintenance\b
\berror establishing a\b
\bunexpected error (?:has )?occurred\b
\b(?:sorry|oops)\W+something went wrong\b
\bsomething went wrong on our (?:side|end)\b
^\W*traceback \(most recent call last\)
^\s*file "[^"]+", line \d+
^\W*(?:[a-z_]\w*\.)*[a-z]\w*(?:error|exception)\b(?::| at )
\bupstream connect error\b
\breset reason:
\bconnection (?:was )?(?:timed out|refused|reset by)\b
\b(?:enable|activate|turn on|switch on) (?:javascript|scripts)\b
\bjavascript (?:is|seems to be|has been|was) (?:disabled|required|turned off|switched off|not enabled|blocked)\b
\b(?:page|site|app|website) requires (?:scripts|javascript|cookies)
\ballow scripts and\b
\bscripts are (?:blocked|disabled|turned off)\b
\bnot support (?:scripting|javascript|scripts)\b
\bwith scripts (?:switched|turned) on\b
\blets our scripts through\b
\bjavascript (?:zu )?aktivieren\b|\baktivieren sie (?:bitte )?javascript\b
\bactiv(?:ar|e|a) javascript\b|\bhabilit(?:ar|e|a) javascript\b
\bactive[zr] javascript\b
\byour text (?:goes )?here\b
\breplace this (?:paragraph|text|sentence)\b
\bsample (?:post|page)\b.*\b(?:edit|delete)\b|^\W*(?:sample|test) (?:post|page)\W*$
\bclick (?:here )?to edit\b
\b(body text\W+){{2}}
^\W*(?:sub)?heading(?: (?:one|two|three|\d))?\W*$
\bdummy (?:headline|teaser|copy|text|title)\b
\bplaceholder (?:copy|text|for)\b
\bfinal text to follow\b
\bblindtext\b|\btexto de relleno\b|\bfaux[- ]texte\b
\btbd\W+tbd\b
\b(xxx\W+)+xxx\b
\b(?:test\W+){{2}}test\b
\basdf\W+asdf\b
\blorem ipsum dolor\b
^\W*sorry, this page is not available\W*$
<(?:!doctype|html|head|title|body)\b
^\W*(?:php )?(?:warning|notice|fatal error|parse error|uncaught \w+|deprecated)\s?: .*(?:\bon line\b|\bin /|failed|undefined|\(\))
\bfailed to open stream\b|\bno such file or directory\b|\bstack trace:|\bsegmentation fault\b|\bout of memory\b
^\W*cannot (?:get|post) /
^\W*(?:your )?session (?:has )?(?:expired|timed out)\b
\bcookies (?:are|must be|need to be) (?:disabled|enabled|blocked|turned on)\b
\bplease (?:try again later|reload (?:the|this) page|contact the (?:site|server) (?:owner|administrator))\b
\bservice is (?:temporarily )?unavailable\b|\btemporarily unavailable\b.{0,40}$
^\W*(?:index of /|it works!|hello world|untitled document|coming soon|under construction|welcome to nginx|apache2? .*default page)
\b(?:domain|website) (?:is|may be) for sale\b|\bdomain is parked\b
\b(?:add|enter|insert|write|put) (?:your|some|a|the) (?:own )?(?:text|content|title|copy|description|headline) here\b
\b(?:text|copy|content|recipe|photo) (?:to come|to follow|coming soon)\b
\b(?:mustertext|platzhalter(?:text)?|texto de (?:ejemplo|prueba|muestra)|texte? (?:d['’]exemple|provisoire))\b
\bthe quick brown fox jumps\b
\binterner serverfehler\b|\berror interno del servidor\b|\berreur interne du serveur\b
\bzugriff verweigert\b|\bacceso denegado\b|\bacc[eè]s refus[eé]\b
\bzu viele anfragen\b|\bdemasiadas (?:solicitudes|peticiones)\b|\btrop de requ[eê]tes\b
\b(?:seite|inhalt) (?:ist|steht) (?:derzeit |leider )*nicht (?:mehr )?(?:verf[uü]gbar|erreichbar)\b
\bp[aá]gina no est[aá] disponible\b|\bcontenido no est[aá] disponible\b
\b(?:page|contenu) n['’]est (?:pas|plus) disponible\b
\b(?:site|sitio|p[aá]gina|seite) (?:est|est[aá]|ist)\b.{{0,20}}\b(?:maintenance|mantenimiento|wartung)\b
\bjavascript (?:ist|est|est[aá]) (?:deaktiviert|d[eé]sactiv[eé]|desactivado)\b
""".strip().splitlines()
_LATIN = set(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
    "duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "vivamus vitae mauris pulvinar porta congue cursus dignissim sagittis semper lectus tortor nunc donec vestibulum curabitur pellentesque suspendisse".split()
)
_NAME = r"[A-Za-z_][\w.]*(?:[ .][\w.]+){0,4}"
_PLACEHOLDERS = rf"""
\{{\{{+[^{{}}\n]{{0,80}}\}}\}}+
\$\{{[^{{}}\n]{{0,80}}\}}
\#\{{[^{{}}\n]{{0,80}}\}}
\{{%-?\s*\w[^%\n]{{0,80}}%\}}
<%[=-]?[^%\n]{{0,80}}%>
\{{[a-z_][\w.]*\}}
\[\[\s*[A-Za-z_][\w. ]*\]\]
%%[A-Za-z_][\w.]*%%
@@[A-Za-z_][\w.]*@@
__[A-Za-z]\w*?__
\*\|[A-Za-z_][\w.:]*\|\*
%\([A-Za-z_][\w.]*\)[sdif]
\$[A-Z][A-Z0-9_]{{2,}}\$
&lt;[a-z_][\w.]*&gt;
\[(?i:insert|enter|your|add) [^\]\n]{{1,60}}\]
\[object Object\]
\bNaN\b
^\s*undefined\s*$
\bundefined (?:minutes?|hours?|cups?|servings?)\b|\byield: undefined\b
\b(?:cups|minutes|grams) of [\w ]+ and null of\b
(?:\{{\{{+|\$\{{|\#\{{|\{{%|<%=?|%%|@@|\*\||\[\[|%\()\s*[A-Za-z_][\w. ]{{0,40}}$
""".strip().splitlines()
_WORK_NOTE = re.compile(r"^\W*(?:TODO|FIXME|TBD|TKTK|TK)\b(?!\w)")
_MESSAGE = [re.compile(p) for p in _MESSAGES]
_PLACEHOLDER = re.compile("|".join(f"(?:{p})" for p in _PLACEHOLDERS))
_ODD = re.compile(r"[{}\[\]<%@*$&#]|__|NaN|undefined|null of")
_QUOTED = re.compile(r"\"[^\"\n]{1,200}\"|“[^”\n]{1,200}”|„[^“\n]{1,200}“|«[^»\n]{1,200}»")
_HOST = re.compile(r"\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}\b")
_HEX = re.compile(r"\b(?=[a-f]*\d)[0-9a-f]{4,}\b")
_DIGITS = re.compile(r"\d+")
_DOTTED = re.compile(r"\w\.[a-z]")
_TOKEN = re.compile(r"\w+")


@cache
def triggers(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """An automaton that finds any of the words."""
    automaton = ahocorasick.Automaton()
    for word in words:
        automaton.add_word(word, word)
    automaton.make_automaton()
    return automaton


#: Strings that a stretch of a pattern may stand for, at most.
_SPELLINGS = 400


def _spellings(node: tuple) -> tuple[set[str] | None, set[str] | None]:
    """Of a node of a parsed pattern: all strings that it can match, if they are few, and strings of which each match holds one."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg)}, {chr(arg)}
    if op is sre.IN and all(x[0] is sre.LITERAL for x in arg):
        return (every := {chr(x[1]) for x in arg}), every
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}, None
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        exact, held = ({s for p in parts for s in p[n]} if all(p[n] for p in parts) else None for n in (0, 1))
        return exact if exact and len(exact) <= _SPELLINGS else None, held
    if op is sre.MAX_REPEAT:
        least, most, inner = arg
        exact, held = _sequence(inner)
        return exact | {""} if exact and least == 0 and most == 1 else None, held if least else None
    return None, None


def _sequence(nodes: Iterable[tuple]) -> tuple[set[str] | None, set[str] | None]:
    whole, run, best = True, {""}, [set()]
    for node in nodes:
        exact, held = _spellings(node)
        if held:
            best.append(held)
        grown = {x + y for x in run for y in exact} if exact else set()
        if not 0 < len(grown) <= _SPELLINGS:
            whole, grown = False, exact or {""}
            best.append(run)
        run = grown
    held = max([*best, run], key=lambda strings: min(map(len, strings), default=0))
    return run if whole else None, held if min(map(len, held), default=0) else None


def needed(pattern: str) -> set[str]:
    """Strings of which every match of the pattern holds at least one."""
    held = _sequence(sre.parse(pattern))[1]
    if not held:
        raise ValueError(f"a match of {pattern} needs no fixed string")
    return {s for s in held if not any(t in s and t != s for t in held)}


@cache
def _messages_by_string() -> ahocorasick.Automaton:
    """An automaton of the needed strings of _MESSAGES; the value of each is the numbers of its patterns."""
    of: dict[str, tuple[int, ...]] = {}
    for n, pattern in enumerate(_MESSAGES):
        for s in needed(pattern):
            of[s] = (*of.get(s, ()), n)
    automaton = ahocorasick.Automaton()
    for s, numbers in of.items():
        automaton.add_word(s, numbers)
    automaton.make_automaton()
    return automaton


def _says(low: str) -> bool:
    """Whether any of _MESSAGES matches; only those are tried of which the line holds a needed string."""
    return any(_MESSAGE[n].search(low) for n in {n for _, numbers in _messages_by_string().iter(low) for n in numbers})


def _low(line: str) -> str:
    return (line if line.isascii() else unicodedata.normalize("NFKC", line)).lower()


def label(line: str) -> int:
    """The trusted label of one line: MESSAGE, PLACEHOLDER or NONE."""
    if _ODD.search(line) and _PLACEHOLDER.search(line):
        return PLACEHOLDER
    low = _low(line)
    bare = _QUOTED.sub(" ", low) if '"' in low or "“" in low or "„" in low or "«" in low else low
    if _says(bare) or (bare is not low and low.lstrip().startswith("file ") and _says(low)):
        return MESSAGE
    if _WORK_NOTE.match(line):
        return MESSAGE
    tokens = _TOKEN.findall(low)
    return MESSAGE if len(tokens) >= 4 and sum(map(_LATIN.__contains__, tokens)) >= 0.7 * len(tokens) else NONE


def unit(line: str) -> str:
    """The line without what varies between copies of a message: letter case, hosts, ids, numbers, spacing."""
    low = _low(line)
    if _DOTTED.search(low):
        low = _HOST.sub("@", low)
    if _DIGITS.search(low):
        low = _DIGITS.sub("0", _HEX.sub("#", low))
    return " ".join(low.split())


def simhashes(units: list[str]) -> np.ndarray:
    """64-bit SimHash of each text over its words and pairs of words."""
    lists = [_TOKEN.findall(u) or [u] for u in units]
    votes = np.zeros((len(units), 64), dtype=np.int32)
    for k in (1, 2):
        hashes, offsets = batch_shingles(lists, k)
        some = np.flatnonzero(np.diff(offsets))
        if len(some):
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, offsets[some], axis=0, dtype=np.int32)
            votes[some] += 2 * ones - np.diff(offsets)[some][:, None].astype(np.int32)
    return np.packbits(votes > 0, axis=1, bitorder="little").copy().view(np.uint64).ravel()


def similarity(a: str, b: str) -> float:
    """Jaccard likeness on runs of five words, for texts of under ten words on runs of five characters."""
    x, y = _TOKEN.findall(a), _TOKEN.findall(b)
    if min(len(x), len(y)) < 10:
        x, y = a, b
    s, t = ({tuple(z[i : i + 5]) for i in range(max(1, len(z) - 4))} for z in (x, y))
    return len(s & t) / len(s | t)


def line_units(texts: DataFrame) -> DataFrame:
    """(kind, id, unit, sim, label, text): the distinct lines of (kind STRING, id BIGINT, text STRING) rows, blank ones left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, int, str]] = {}
        for whole in batches:
            for at in range(0, len(whole), 1000):
                part = whole.iloc[at : at + 1000]
                lines = [(k, i, line) for k, i, t in zip(part["kind"], part["id"], part["text"]) if t for line in dict.fromkeys(t.splitlines()) if line.strip()]
                if len(known) > 200_000:
                    known.clear()
                new = [line for line in dict.fromkeys(line for *_, line in lines) if line not in known]
                units = [unit(line) for line in new]
                sims = simhashes(units).view(np.int64).tolist() if new else []
                for line, u, s in zip(new, units, sims):
                    known[line] = (s, label(line), u)
                rows = [known[line] for *_, line in lines]
                yield pd.DataFrame({
                    "kind": [k for k, *_ in lines],
                    "id": [i for _, i, _ in lines],
                    "unit": np.array([xxhash.xxh3_64_intdigest(f"{r[1]}{r[2]}") for r in rows], dtype=np.uint64).view(np.int64),
                    "sim": np.array([r[0] for r in rows], dtype=np.int64),
                    "label": np.array([r[1] for r in rows], dtype=np.int32),
                    "text": [r[2] for r in rows],
                })

    return texts.mapInPandas(run, "kind string, id long, unit long, sim long, label int, text string")


def table_keys(sim: Column) -> Column:
    """The keys of a SimHash in the ten tables."""
    blocks = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
    part = lambda at, bits: F.shiftrightunsigned(sim, at).bitwiseAND(F.lit((1 << bits) - 1))
    return F.array(*(F.lit(n << 26).cast("long").bitwiseOR(F.shiftleft(part(*x), 13)).bitwiseOR(part(*y)) for n, (x, y) in enumerate(combinations(blocks, 2))))


def residue_units(units: DataFrame) -> DataFrame:
    """The units (unit, ...) that carry a trusted label or are connected to one that does; `units` is a written table."""

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.loc[[similarity(a, b) >= SIMILARITY for a, b in zip(p["near"], p["text"])], ["unit"]]

    tables = units.filter(f"label = {NONE}").select("unit", "sim", F.explode(table_keys(F.col("sim"))).alias("key"))
    frontier = persisted(units.filter(f"label = {MESSAGE}").select("unit", "sim", "text"))
    reached = units.filter(f"label > {NONE}").select("unit")
    while not frontier.isEmpty():
        probe = frontier.select(F.col("unit").alias("from"), F.col("sim").alias("near_sim"), F.explode(table_keys(F.col("sim"))).alias("key"))
        met = tables.join(probe, "key").filter(F.bit_count(F.col("sim").bitwiseXOR(F.col("near_sim"))) <= HAMMING).select("unit", "from").distinct()
        both = met.join(frontier.select(F.col("unit").alias("from"), F.col("text").alias("near")), "from").join(units.select("unit", "text"), "unit")
        linked = both.select("unit", "text", "near").mapInPandas(alike, "unit long").distinct().join(reached, "unit", "left_anti")
        frontier = persisted(linked.join(units, "unit").select("unit", "sim", "text"))
        reached = reached.union(frontier.select("unit"))
    return reached


def residue(texts: DataFrame) -> DataFrame:
    """Distinct (kind, id) of the rows of `texts` (kind STRING, id BIGINT, text STRING) that are or contain residue.

    Null, empty and blank texts never count; repeated rows count once; an empty table gives an empty result; further
    columns are ignored.
    """
    lines = persisted(line_units(spread(texts.select("kind", "id", "text").filter("text is not null"))))
    # hash, label and text of one line: where hashes of two units meet, they aren't mixed
    units = persisted(lines.groupBy("unit").agg(F.min(F.struct("text", "sim", "label")).alias("u")).select("unit", "u.sim", "u.label", "u.text"))
    return lines.select("kind", "id", "unit").join(residue_units(units), "unit").select("kind", "id").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_kind, record_id): evidence whose excerpt is or contains residue, fetch attempts whose outcome is residue."""
    excerpts = load(spark, sf_dir, "evidence", "id", "excerpt").select(F.lit("evidence").alias("kind"), "id", F.col("excerpt").alias("text"))
    attempts = load(spark, sf_dir, "fetch_attempts", "id", "outcome").filter("outcome is not null")
    # outcomes repeat, so each distinct one is examined once, under the least id that has it
    outcomes = attempts.groupBy("outcome").agg(F.min("id").alias("id")).select(F.lit("outcome").alias("kind"), "id", F.col("outcome").alias("text"))
    found = persisted(residue(excerpts.union(outcomes)))
    bad = outcomes.join(found.filter("kind = 'outcome'"), "id", "left_semi").select(F.col("text").alias("outcome"))
    attempted = attempts.join(bad, "outcome").select(F.lit("fetch_attempts").alias("record_kind"), F.col("id").alias("record_id")).distinct()
    return found.filter("kind = 'evidence'").select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id")).union(attempted)


QUERIES = {"p4_found": p4_found}
SQL: dict[str, str] = {}
