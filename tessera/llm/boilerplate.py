"""Main body of pages by the distribution of text over blocks of lines.

Markup is stripped first. A line's mass is its length, weighed by what the line looks like: sentences count in full, items
of lists and headings in part, short lines of words little. Lines that usual wordings of site furniture give away, rows of
links between separators, and lines that recur on many pages of the line's site (counted over the corpus) have none, and
the heading of a list of pointers to other pages takes mass away. Masses are summed over sliding windows of WINDOW filled
lines. A line that has mass itself and whose window ahead holds SURGE or more is a surge point: the main body begins, or
begins again. A line whose window ahead holds less than DIVE is a dive point: the body ends, or is interrupted, for instance
by a list of pointers. A surge is decided by the line and what follows; prose that lost its full stop, and the last lines
of a paragraph or list, by what precedes them, too. The page's own title has mass wherever it stands, so the body may begin
with it. Lines outside the body, and lines without mass within it, are boilerplate.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Container, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.residue import MESSAGE, NONE, label, triggers
from tessera.sources.tables import load, persisted, spread

#: Filled lines a window, the sums that make a surge and a dive, the mass that a surge or list line has itself, and the least mass of the own title.
WINDOW, SURGE, DIVE, OWN, TITLE = 3, 35, 20, 10, 30
#: A line of this length or more is the site's if it stands on pages with so many titles and on such a share of the site's.
SITE_CHARS, SITE_TITLES, SITE_SHARE = 40, 5, 0.05

# Usual wordings of site furniture in English, German, Spanish and French; lower case, whole lines.
_WHOLE = r"""
(?:skip|jump) to (?:main |the )?(?:content|recipe|navigation|comments)
(?:open |close |main )?menu|close|home|search(?: this site)?|sitemap|site map|imprint|privacy(?: policy| notice)?|legal(?: notice)?|terms(?: of (?:use|service))?|accessibility|careers|jobs|press|faq|help|cookie settings|cookies
(?:log|sign) (?:in|up|out)(?: or (?:join|register))?|register|subscribe(?: now| and save.*)?|my account|print edition|newsletter|contact(?: us)?|about(?: us)?
advertise(?: with us)?|advertisement|sponsored(?: content)?|anzeige|werbung|publicidad|publicité|patrocinado|sponsorisé
(?:back to|nach) (?:the )?(?:top|oben)|volver arriba|haut de page|to the top
accept(?: all| cookies)?|i agree|agree|got it|ok|only necessary|reject(?: optional| all)?|save settings|manage (?:choices|preferences|cookies)|(?:necessary|essential) only|allow all|decline|customi[sz]e
alle akzeptieren|akzeptieren|ablehnen|einstellungen|nur notwendige|zustimmen|aceptar(?: todo)?|rechazar(?: todo)?|configurar|tout accepter|accepter|tout refuser|refuser|paramétrer
(?:\d[\d.,]*k?|no) (?:shares?|comments?|likes?|views?|kommentare?|comentarios?|commentaires?|mal geteilt|compartidos|partages?)
leave a (?:reply|comment)|(?:log|sign) in to (?:comment|reply)|post a comment|join the (?:conversation|discussion)|comments?|kommentare?|comentarios|commentaires|kommentar schreiben|deja un comentario|laisser un commentaire
(?:share|print|email|save|pin|rate|tweet)(?: (?:this|it|the|to))?(?: (?:page|article|recipe|story|my recipe box|recipe box))*|seite drucken|artikel (?:teilen|drucken)|compartir(?: esta página)?|imprimir|partager(?: cette page)?|imprimer
rate this recipe.*|download (?:our|the) app.*|open the gallery.*|save to my recipe box|loading more stories\W*|load more.*|show more|see all.*|view all.*
(?:sign up|subscribe|register) (?:for|to) .*|join [\d.,]+ (?:readers|subscribers).*|enter your e-?mail(?: address)?|your e-?mail(?: address)?|get .{2,40} in your inbox.*|newsletter abonnieren|suscríbete(?: al? .*)?|inscrivez-vous.*|abonnez-vous.*|jetzt abonnieren
(?:follow us|folgen sie uns|síguenos|suivez-nous)(?:\W.*)?
(?:tags?|filed under|schlagwörter|etiquetas|mots-clés|posted in|categories|category)\b\W* .{1,120}
(?:previous|next|older|newer)(?: (?:post|article|story|page))?\W{1,3}.{0,120}|(?:zurück|weiter|anterior|siguiente|précédent|suivant)\W{1,3}.{1,120}
zum inhalt springen|saltar al contenido|aller au contenu|menü|menú|menu principal|startseite|inicio|accueil|suche|buscar|rechercher|kontakt|contacto|anmelden|acceder|connexion|über uns|quiénes somos|impressum|datenschutz|agb|aviso legal|privacidad|mentions légales|confidentialité|cgu
""".strip().splitlines()
_PART = r"""
©|\bcopyright \d{4}\b|\(c\) \d{4}\b|\ball rights reserved\b|\balle rechte vorbehalten\b|\btodos los derechos\b|\btous droits\b
\bregistered office\b|\bfamily of sites\b|\bist ein angebot von\b|\bes un sitio de\b|\best un site d[eu]\b|\bof this website\b|\bterms of use\b
\b(?:earn|receive) (?:a |an )?(?:affiliate |small )?commission\b|\baffiliate (?:links?|partners?|program)\b|\bfollow us\b ?:
\b(?:use|uses|using|set|sets|use of|optional|necessary|our) cookies\b|\bcookies (?:and similar|to|for|so that|zu|für|um|para|con|propias|pour|à|afin|y)\b(?=.{0,90}(?:visit|ads|remember|improve|personali|statisti|market|werbung|erlebnis|publicit|mejorar|mesurer|améliorer|medir|expérience|running))
\bpartners store information\b|\bstore information on your device\b|\b(?:nutzt|verwenden|setzt|verwendet) cookies\b|\b(?:utiliza|utilizamos|usamos|usa) cookies\b|\b(?:utilise|utilisons|dépose|déposons) (?:des )?(?:cookies|traceurs)\b|\byour privacy matters\b
\bchange this at any time in the settings\b|\bsee our privacy notice\b|\bchoose what you allow\b
""".strip().splitlines()
_POINTER = r"""
editor['’]s picks?|most (?:read|popular|shared)(?: .{1,20})?|popular (?:in|on|now|right now)\b.{0,40}|related (?:stories|articles|posts|recipes|reading|content)|(?:from|by) our partners|trending(?: now| on .*)?|you (?:may|might) (?:also )?(?:like|enjoy)|more (?:from|on|in|stories|to read)\b.{0,50}|read (?:next|also|this next)|recommended(?: for you)?|latest (?:stories|news|articles|posts)|keep reading|up next|what to read next|don['’]t miss|in this section|(?:also|elsewhere) on .{1,40}
das könnte (?:sie|dich) auch interessieren|meistgelesen|mehr (?:von|aus|zum|zu)\b.{0,50}|beliebt(?: .*)?|weitere (?:artikel|themen|beiträge)|lesen sie auch|empfehlungen|aktuell(?:es)?
también te puede interesar|lo más (?:leído|visto)|más (?:de|sobre|en)\b.{0,50}|te puede gustar|artículos relacionados|lee también|recomendados
à lire aussi|les plus (?:lus|populaires)|plus (?:de|sur)\b.{0,50}|vous aimerez (?:aussi|peut-être)|articles (?:liés|similaires)|voir aussi|à ne pas manquer|sur le même (?:thème|sujet)
""".strip().splitlines()
_MORE = re.compile(r"(?:\b(?:read|see|show|view|learn) (?:more|on)|\bcontinue(?: reading)?|\bweiter\s?lesen|\bmehr lesen|\b(?:leer|ver|seguir) (?:más|leyendo)|\blire (?:la suite|plus)|\ben savoir plus|\bsuite)\W*$|[»›→]\s*$|(?:…|\.\.\.)\s*$", re.I)
_HEADS = re.compile(
    r"(?:ingredients?|method|directions|instructions|steps?|step by step|equipment|storage|notes?|tips?|variations?|nutrition|serving|background|conclusion|summary|introduction|why it works|before you (?:begin|start)|what (?:you will|you['’]ll) need|who does what\??|share of the work|questions from readers|what about .{2,40}\?|(?:how|can|when|why|where|which|what|should|is|do|does) .{2,60}\?"
    r"|zutaten|zubereitung|anleitung|schritt für schritt|was man braucht|tipps .{2,40}|lagerung|hinweise|ausstattung|warum .{2,40}|wie .{2,60}\?|kann .{2,60}\?"
    r"|ingredientes|preparación|elaboración|paso a paso|consejos .{2,40}|conservación|notas|utensilios|¿.{2,60}\?|por qué .{2,40}"
    r"|ingrédients|préparation|étapes|le matériel|conservation.{0,30}|conseils .{2,40}|remarques|pourquoi .{2,40}|comment .{2,60}\s?\?)\W*",
    re.I,
)
_WHOLE_LINE = re.compile("(?:" + "|".join(f"(?:{p})" for p in _WHOLE) + r")\W*", re.I)
_PARTS = re.compile("|".join(_PART), re.I)
#: A line that _PARTS matches contains one of these.
_PART_TRIGGERS = tuple(
    "©|copyright|(c)|rights reserved|rechte vorbehalten|los derechos|tous droits|registered office|family of sites|angebot von|sitio de|site d|of this website|terms of use|commission|"
    "follow us|affiliate|cookies|traceurs|partners store|store information|privacy|in the settings|choose what".split("|")
)
_POINTERS = re.compile("(?:" + "|".join(_POINTER) + r")\W*", re.I)
_SEPARATED = re.compile(r"\s(?:[|•·/>»›]|&gt;|&raquo;)\s")
_ITEM = re.compile(
    r"(?:(?:\d+(?:[.,/]\d+)?|[½¼¾⅓⅔⅛])(?:\s?[-–]\s?\d+)?\s+(?!ways\b|ideas\b|ideen\b|idées\b|tips?\b|tipps\b|maneras\b|façons\b|things\b|reasons\b|mistakes\b|trucos\b|conseils\b|recipes\b|rezepte\b|recetas\b|recettes\b|arten\b|people\b|steps\b|formas\b|manières\b|astuces\b|consejos\b|gründe\b)\S"
    r"|(?:a|an|half|one|two|three|four|some|eine?|zwei|drei|etwas|una?|dos|tres|media|un peu|une?|deux|trois)\s.{0,30}(?:pinch|handful|cup|quarter|splash|knob|spoon|clove|slice|bunch|dash|tablespoon|teaspoon|prise|handvoll|tasse|löffel|pizca|puñado|taza|cucharad|pincée|poignée|tasse|cuillère)"
    r"|[a-zäöüéèàáíóúñç].{1,60}$)",
)
_MARKUP = re.compile(r"<[a-zA-Z/!][^<>]{0,300}>")  # may span lines
_END = re.compile(r"[.!?…:;]['\"”’»)\]]*\s*$")
_WORD = re.compile(r"[^\W_]+")
#: Lines that belong to a message which stands in place of an article.
_NOTICE = re.compile(r"loading\W*|(?:incident|reference|ref|request(?: id)?|session|error code|ray id)\b\W*[\w-]+|nginx.{0,20}|apache.{0,40}", re.I)
_STEP = re.compile(r"\d{1,3}[.)]\s+\S")


def _as_blank(tag: re.Match) -> str:
    return "\n" * tag[0].count("\n") or " "


def plain(line: str) -> str:
    """The line without character references, with spaces folded."""
    return " ".join((html.unescape(line) if "&" in line else line).split())


def _folded(text: str) -> str:
    return " ".join(_WORD.findall(unicodedata.normalize("NFKC", text).lower()))


BLANK, FURNITURE, POINTER, TEASER, SENTENCE, ITEM, HEAD, SHORT, LONG, NOTICE = range(10)


def shape(line: str) -> int:
    """What one line (plain) looks like by itself."""
    if not line:
        return BLANK
    if _POINTERS.fullmatch(line):
        return POINTER
    if _WHOLE_LINE.fullmatch(line) or (next(triggers(_PART_TRIGGERS).iter(line.lower()), None) and _PARTS.search(line)):
        return FURNITURE
    words = line.count(" ") + 1
    if _SEPARATED.search(line) and not _END.search(line) and len(line) < 400:
        return FURNITURE
    if _HEADS.fullmatch(line):
        return HEAD
    if words >= 3 and _MORE.search(line[-60:]):
        return TEASER
    if _NOTICE.fullmatch(line) or label(line) != NONE:
        return NOTICE
    if (words >= 4 and _END.search(line)) or _STEP.match(line):
        return SENTENCE
    if words <= 12 and _ITEM.match(line):
        return ITEM
    # prose that lost its full stop, unlike a row of menu entries
    return LONG if words >= 10 and sum(w[:1].isupper() for w in line.split()) < 0.5 * words else SHORT


#: What a character of a line weighs by the line's shape, and the most and least that such a line weighs.
_WEIGHT = {BLANK: (0.0, 0, 0), FURNITURE: (0.0, 0, 0), POINTER: (0.0, -1000, -1000), TEASER: (0.0, 0, 0), SENTENCE: (1.0, 400, 35), ITEM: (0.7, 100, 20), HEAD: (0.4, 20, 15), SHORT: (0.15, 9, 0), LONG: (0.15, 9, 0), NOTICE: (1.0, 400, 50)}


def mass(line: str, s: int) -> float:
    """Mass of a plain line of shape s."""
    weight, most, least = _WEIGHT[s]
    return max(least, min(most, weight * len(line)))


def boilerplate_lines(text: str, titles: tuple[str, ...] = (), known: dict[str, int] | None = None, recurring: Container[int] = ()) -> list[int]:
    """Numbers, from 1, of the boilerplate lines of a page text; `titles` are forms of the page's own title, `recurring`
    the numbers of lines that are known to be the site's.

    Blank lines are never among them. A text that never surges is boilerplate altogether, but for its title.
    """
    known = {} if known is None else known
    lines = [plain(x) for x in (_MARKUP.sub(_as_blank, text) if "<" in text else text).split("\n")]
    shapes = []
    for n, line in enumerate(lines, 1):
        s = known.get(line)
        if s is None:
            s = known[line] = shape(line)
        shapes.append(FURNITURE if n in recurring and s != BLANK else s)
    own = {f for t in titles if t and (f := _folded(t))}
    filled = [i for i, s in enumerate(shapes) if s != BLANK]
    masses = [mass(lines[i], shapes[i]) for i in filled]
    _, surge = _body(masses, [shapes[i] == LONG for i in filled])
    title = _title(lines, shapes, filled, surge, own)
    if title is not None and surge is not None:
        masses[filled.index(title)] = max(TITLE, masses[filled.index(title)])
    main = {filled[n] for n in _body(masses, [shapes[i] == LONG for i in filled])[0]} | {title}
    return [i + 1 for i in filled if i not in main]


def _body(masses: list[float], trailing: list[bool]) -> tuple[list[int], int | None]:
    """Places of the lines of the body among the filled lines, and the place of its first surge; `trailing` are lines that
    may end a body though they have little mass themselves."""
    body, first, inside = [], None, False
    for n, m in enumerate(masses):
        ahead = m + sum(max(0, x) for x in masses[n + 1 : n + WINDOW])
        if inside:
            inside = ahead >= DIVE or ((trailing[n] or m >= OWN) and sum(masses[max(0, n - WINDOW + 1) : n + 1]) >= DIVE)
        elif m >= OWN and ahead >= SURGE:
            inside = True
            first = n if first is None else first
        if inside and m > 0:
            body.append(n)
    return body, first


def _title(lines: list[str], shapes: list[int], filled: list[int], surge: int | None, own: set[str]) -> int | None:
    """The line of the page's own title: the last that equals it before the surge, else soon after, else the line before."""
    before = filled if surge is None else filled[:surge]
    for i in reversed(before):
        if shapes[i] not in (FURNITURE, POINTER) and _folded(lines[i]) in own:
            return i
    if surge is None:
        return None
    for i in filled[surge : surge + 3]:
        if shapes[i] != FURNITURE and _folded(lines[i]) in own:
            return i
    last = before[-1] if before else None
    if last is not None and shapes[last] in (SHORT, LONG, TEASER) and lines[last].count(" ") >= 3 and label(lines[filled[surge]]) != MESSAGE:
        return last
    return None


def boilerplate(pages: DataFrame) -> DataFrame:
    """(id, line_no) of boilerplate lines by the line-block distribution of each page.

    `pages` has id BIGINT, text STRING, title STRING (may be null), recurring ARRAY<INT> (may be null); further columns are
    ignored. Null and empty texts have no lines; repeated rows repeat their lines.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for whole in batches:
            ids, numbers = [], []
            for i, text, title, recurring in zip(whole["id"], whole["text"], whole["title"], whole["recurring"]):
                if text:
                    if len(known) > 200_000:
                        known.clear()
                    found = boilerplate_lines(text, (title,) if title else (), known, () if recurring is None else set(recurring.tolist()))
                    ids += [i] * len(found)
                    numbers += found
            yield pd.DataFrame({"id": pd.array(ids, dtype="int64"), "line_no": pd.array(numbers, dtype="int32")})

    return pages.select("id", "text", "title", "recurring").mapInPandas(run, "id long, line_no int")


def site_lines(texts: DataFrame, about: DataFrame) -> DataFrame:
    """(id, line_no) of long lines that recur on many pages of their site, numbers apart.

    `texts` has id BIGINT, text STRING, `about` id, site STRING, title STRING; pages without a site have none. Counted over
    all pages; pages with one title count once, since they may be copies or versions of one article.
    """
    page = about.filter("site is not null").select("id", "site", F.xxhash64(F.coalesce("title", F.col("id").cast("string"))).alias("page"))
    lines = spread(texts.select("id", "text")).select("id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", r"[\s\u00a0]+", " "))).filter(F.length("line") >= SITE_CHARS)
    # lines become keys before they are shuffled, and once for both uses
    keyed = persisted(lines.select("id", (F.col("at") + 1).cast("int").alias("line_no"), F.xxhash64(F.regexp_replace("line", r"\d+", "0")).alias("key")).join(page, "id"))
    total = page.join(texts.select("id").distinct(), "id", "left_semi").groupBy("site").agg(F.countDistinct("page").alias("pages"))
    often = keyed.groupBy("site", "key").agg(F.countDistinct("page").alias("n")).filter(f"n >= {SITE_TITLES}")
    often = often.join(total, "site").filter(F.col("n") >= F.col("pages") * SITE_SHARE).select("site", "key")
    return keyed.join(often, ["site", "key"]).select("id", "line_no")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(evidence_id, line_no): the boilerplate lines of evidence_text.text."""
    texts = load(spark, sf_dir, "evidence_text").select(F.col("evidence_id").alias("id"), "text").filter("text is not null")
    about = load(spark, sf_dir, "evidence", "id", "url", "title").select("id", F.lower(F.regexp_extract("url", r"^\w+://([^/?#:]+)", 1)).alias("site"), "title")
    recurring = site_lines(texts, about).groupBy("id").agg(F.collect_set("line_no").alias("recurring"))
    found = boilerplate(spread(texts).join(about.select("id", "title"), "id", "left").join(recurring, "id", "left")).distinct()
    return found.select(F.col("id").alias("evidence_id"), "line_no")


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
