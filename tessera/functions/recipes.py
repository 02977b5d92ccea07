"""Records (recipes) located in a page: structured data first, headings else, every unit with its span in the page's text."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tessera.functions.html import parsed_json

# The headings that open a list of steps, and those that end it; the keys of structured data.
STEP_HEADINGS = {"method", "directions", "instructions", "steps", "preparation", "procedure"}
SECTION_ENDS = {
    "notes", "note", "contributor(s)", "nutrition", "nutrition facts", "nutritional facts", "recipe video", "prep time", "cook time", "total time", "yield", "yields", "servings", "serving size",
    "did you make this recipe?", "comments", "related",
}
ROLES = {"servings": ("recipeYield", "yields?|servings|serves"), "prep_time": ("prepTime", "prep time|prep"), "cook_time": ("cookTime", "cook time|cook"), "total_time": ("totalTime", "total time|total")}
_LINE = {role: re.compile(rf"(?im)^\s*(?:{labels})(?:\s*:\s*|\s+)(\d[^\n]{{0,59}})$") for role, (_, labels) in ROLES.items()}

UNIT = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("raw", StringType()), StructField("how", StringType())])
RECORDS = ArrayType(StructType([StructField("tier", StringType()), StructField("slot", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("units", ArrayType(UNIT))]))


class _Markup(HTMLParser):
    """JSON-LD texts, and the values of microdata properties in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blobs: list[str] = []
        self.in_blob = False
        self.open: list[tuple[str, str, list[str]]] = []
        self.values: dict[str, list[str]] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "script" and (a.get("type") or "").strip().lower() == "application/ld+json":
            self.in_blob = True
            self.blobs.append("")
        for name in (a.get("itemprop") or "").split():
            if "content" in a or "datetime" in a:
                self.values.setdefault(name, []).append(a.get("content") or a.get("datetime") or "")
            else:
                self.open.append((tag, name, []))

    def handle_data(self, data: str) -> None:
        if self.in_blob:
            self.blobs[-1] += data
        for _, _, parts in self.open:
            parts.append(data)

    def handle_endtag(self, tag: str) -> None:
        self.in_blob = self.in_blob and tag != "script"
        for n in range(len(self.open) - 1, -1, -1):
            if self.open[n][0] == tag:
                _, name, parts = self.open.pop(n)
                self.values.setdefault(name, []).append("".join(parts))
                break


def _nodes(value: object, kind: str) -> Iterator[dict]:
    todo = [value]
    while todo:
        at = todo.pop()
        if isinstance(at, dict):
            of = at.get("@type")
            if of == kind or (isinstance(of, list) and kind in of):
                yield at
            at = list(at.values())
        if isinstance(at, list):
            todo += reversed(at)


def _texts(value: object) -> Iterator[str]:
    """Step texts: plain ones, the text of a step, the items of a section."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        for x in value:
            yield from _texts(x)
    elif isinstance(value, dict):
        yield from _texts(value["text"] if isinstance(value.get("text"), str) else value.get("itemListElement"))


def _plain(value: object) -> str:
    return " ".join(re.sub(r"<[^>]+>", " ", entities.unescape(str(value))).split())


def places(text: str, literal: str) -> list[tuple[int, int]]:
    """All spans of a literal, overlapping ones too, letter case apart where that keeps the length of the text."""
    if not literal:
        return []
    fold = text.lower() if len(text.lower()) == len(text) and len(literal.lower()) == len(literal) else text
    sought = literal.lower() if fold is not text else literal
    out, at = [], fold.find(sought)
    while at >= 0:
        out.append((at, at + len(literal)))
        at = fold.find(sought, at + 1)
    return out


def _role_units(text: str, anchor: int) -> list[tuple]:
    """The labelled value of each role that stands nearest to the anchor."""
    out = []
    for role, line in _LINE.items():
        found = min(line.finditer(text), key=lambda m: (abs(m.start() - anchor), m.start()), default=None)
        if found:
            value = found[1].strip()
            out.append((role, found.start(1), found.start(1) + len(value), None, "exact"))
    return out


def _structured(node: dict, text: str, tier: str) -> tuple[dict, bool]:
    """The record of a structured node, and whether all its ingredients are in the text and all its steps there once."""
    units, whole = [], True
    for kind, raws in (("ingredient", [x for x in node.get("recipeIngredient") or [] if isinstance(x, str)]), ("step", list(_texts(node.get("recipeInstructions"))))):
        for raw in raws:
            at = places(text, _plain(raw))
            how = "unmatched" if not at else "exact" if len(at) == 1 else "ambiguous"
            whole &= how != "unmatched" if kind == "ingredient" else how == "exact"
            units.append((kind, *(at[0] if at else (-1, -1)), raw, how))
    anchor = min((u[1] for u in units if u[1] >= 0), default=0)
    seen = {u[0]: u for u in _role_units(text, anchor)}
    for role, (key, _) in ROLES.items():
        given = node.get(key)
        raw = "; ".join(str(x) for x in (given if isinstance(given, list) else [given]) if isinstance(x, (str, int, float)))
        if raw or role in seen:
            units.append((role, *seen.get(role, (role, -1, -1))[1:3], raw or None, "exact" if role in seen else "unmatched"))
    names = node.get("name") if isinstance(node.get("name"), list) else [node.get("name")]
    name = _plain(names[0]) if names and isinstance(names[0], (str, int, float)) else ""
    return _record(tier, text, units, name, anchor), whole


def _record(tier: str, text: str, units: list[tuple], name: str, anchor: int) -> dict:
    at = places(text, name)
    if at:
        # the last one before the units, else the first
        span = next((s for s in reversed(at) if s[0] <= anchor), at[0])
        units = [("name", *span, name, "exact"), *units]
    spans = [u for u in units if u[1] >= 0]
    return {"tier": tier, "start": min((u[1] for u in spans), default=0), "end": max((u[2] for u in spans), default=0), "units": units}


def _by_headings(text: str, title: str | None) -> dict | None:
    """The record between the heading of ingredients and the end of the steps after it."""
    lines, at = [], 0
    for line in text.split("\n"):
        bare = line.strip().lstrip("▢☐ ").strip()
        lines.append((bare, at + (line.find(bare) if bare else 0)))
        at += len(line) + 1
    first = next((n for n, (x, _) in enumerate(lines) if x.lower() == "ingredients"), None)
    steps = next((n for n, (x, _) in enumerate(lines) if x.lower() in STEP_HEADINGS), None)
    if first is None or steps is None or steps <= first:
        return None
    units = [("ingredient", s, s + len(x), None, "exact") for x, s in lines[first + 1 : steps] if x]
    for x, s in lines[steps + 1 :]:
        if x.lower() in SECTION_ENDS:
            break
        if x:
            units.append(("step", s, s + len(x), None, "exact"))
    if {u[0] for u in units} != {"ingredient", "step"}:
        return None
    return _record("heading", text, units + _role_units(text, units[0][1]), title or "", units[0][1])


def locate_records(html: str | None, text: str | None, title: str | None) -> list[dict]:
    """The records of a page: from JSON-LD, else microdata, where all units are found in the text, else from its headings.

    Each has a tier, bounds, units (kind, start, end, raw, how; spans in code points, -1 where not found) and a slot: a key
    of its name, with #2 and so on for further records of one name; none without a name. A null or empty page has none.
    """
    page = _Markup()
    page.feed(html or "")
    page.close()
    text = text or ""
    nodes = [(n, "jsonld") for b in page.blobs for n in _nodes(parsed_json(b), "Recipe")]
    if not nodes and page.values.get("recipeIngredient"):
        v = page.values
        nodes = [({"name": (v.get("name") or [title])[0], "recipeIngredient": v["recipeIngredient"], "recipeInstructions": v.get("recipeInstructions", []), **{k: v.get(k) for k, _ in ROLES.values()}}, "microdata")]
    judged = [_structured(n, text, tier) for n, tier in nodes]
    records = [r for r, whole in judged if whole]
    if not records and (found := _by_headings(text, title)):
        refused = [r for r, _ in judged]
        named = [u for u in refused[0]["units"] if u[0] == "ingredient"] if len(refused) == 1 else []
        mine = [n for n, u in enumerate(found["units"]) if u[0] == "ingredient"]
        if len(named) == len(mine):
            # what the structured data say stays with the visible unit, and whether both agree
            for n, other in zip(mine, named):
                kind, s, e, _, _ = found["units"][n]
                found["units"][n] = (kind, s, e, other[3], "exact" if _plain(other[3]).casefold() == text[s:e].casefold() else other[4])
        records = [found]
    seen: dict[str, int] = {}
    for r in records:
        name = next((text[u[1] : u[2]] for u in r["units"] if u[0] == "name"), "")
        key = "name:" + hashlib.sha256(" ".join(name.split()).casefold().encode()).hexdigest()[:16]
        seen[key] = seen.get(key, 0) + 1
        r["slot"] = None if not name else key if seen[key] == 1 else f"{key}#{seen[key]}"
    return records


def bind_record(text: str, record: dict) -> tuple[str, list[str]]:
    """(completeness, reasons) of a located record as it would be proposed from its own spans.

    Complete records have a name, ingredients and steps that stand once, in order and as given, and roles whose structured
    and visible readings agree; usable ones lack only roles; the others are partial. Reasons are sorted and distinct.
    """
    reasons = {f"no_{kind}" for kind in ("name", "ingredient", "step") if not any(u[0] == kind and u[1] >= 0 for u in record["units"])}
    last: dict[str, int] = {}
    for kind, s, e, raw, how in record["units"]:
        if kind in ROLES:
            if raw and s >= 0 and _number(raw) != _number(text[s:e]):
                reasons.add(f"conflict:{kind}")
            elif s < 0:
                reasons.add(f"not_visible:{kind}")
            continue
        if how != "exact":
            reasons.add(f"{how}:{kind}")
        if kind != "name" and s >= 0:
            if s < last.get(kind, -1):
                reasons.add(f"order:{kind}")
            last[kind] = s
    roles = {r for r in reasons if r.split(":")[-1] in ROLES}
    return "complete" if not reasons else "usable" if reasons == roles else "partial", sorted(reasons)


def _number(value: str) -> int | None:
    """Minutes of an ISO or spelled duration, else the first whole number."""
    iso = re.fullmatch(r"\s*PT(?:(\d+)H)?(?:(\d+)M)?\s*", value, re.I)
    hours, minutes = (iso[1], iso[2]) if iso else (m[1] if (m := re.search(p, value, re.I)) else None for p in (r"(\d+)\s*(?:hours?|hrs?)", r"(\d+)\s*(?:minutes?|mins?)"))
    if hours or minutes:
        return 60 * int(hours or 0) + int(minutes or 0)
    return int(m[0]) if (m := re.search(r"\d+", value)) else None


@F.pandas_udf(RECORDS)
def located(html: pd.Series, text: pd.Series, title: pd.Series) -> pd.Series:
    """locate_records as a column."""
    return pd.Series([[{**r, "units": [dict(zip(("kind", "start", "end", "raw", "how"), u)) for u in r["units"]]} for r in locate_records(*x)] for x in zip(html, text, title)])


@F.pandas_udf(StructType([StructField("completeness", StringType()), StructField("reasons", ArrayType(StringType()))]))
def bindings(html: pd.Series, text: pd.Series, title: pd.Series) -> pd.DataFrame:
    """bind_record of the first record of each page; nulls where there is none."""
    rows = [(bind_record(t or "", r[0]) if (r := locate_records(h, t, x)) else (None, None)) for h, t, x in zip(html, text, title)]
    return pd.DataFrame(rows, columns=["completeness", "reasons"])
