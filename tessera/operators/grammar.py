"""Closed grammars of servings, times, amounts and lists, and what is read by them.

Each query reads whole columns of the store and, with negative ids, a few literal rows that spell out the forms which the
store's texts may lack. Null and empty texts read as nothing; repeated rows repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.texts import sentence_key, sentences
from tessera.sources.tables import load

# The forms that count as a statement of servings or of a time, nothing else does.
_N = "[0-9]{1,3}"
_MOD = "(?:generous|large|big|hearty|ample|modest|small|smaller|moderate|more)"
_RANGE = rf"({_N})(?:\s*(?:to|-|–|—)\s*({_N}))?"
_LABEL = r"(?:(?:(?:this|the)\s+)?recipe\s+)?(?:yields?|serves|servings)\s*:?\s*"
_TRAIL, _CLOSE = r"\s+servings?", r"\s*[.)!;,]?\s*$"
SERVINGS = (rf"(?i)^{_LABEL}{_RANGE}(?:{_TRAIL})?{_CLOSE}", rf"(?i)^{_LABEL}({_N})(?:\s+{_MOD}){{0,2}}\s+or\s+({_N})(?:\s+{_MOD}){{0,2}}{_TRAIL}{_CLOSE}", rf"(?i)^\(?{_RANGE}{_TRAIL}{_CLOSE}")
_HOURS, _MINUTES = "(?:hours?|hrs?)", "(?:minutes?|mins?)"
_M = rf"([0-9]{{1,3}})\s*{_MINUTES}(?:\s+{_MINUTES})?"
DURATION = rf"(?:([0-9]{{1,2}})\s*{_HOURS}(?:\s+{_HOURS})?(?:\s*{_M})?|{_M}|PT(?:([0-9]{{1,2}})H)?(?:([0-9]{{1,3}})M)?)"
TIMES = rf"(?i)^(prep|cook|total)(?:\s+time)?\s*:?\s*{DURATION}{_CLOSE}"
ICON = "^[⏲🍳🍽]\ufe0f?[ \t]+"
# Fraction signs, and the unit that each spelling stands for.
FRACTIONS = {"½": 1 / 2, "¼": 1 / 4, "¾": 3 / 4, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 1 / 8, "⅜": 3 / 8, "⅝": 5 / 8, "⅞": 7 / 8}
UNITS = {"tsp": "teaspoon teaspoons tsp", "tbsp": "tablespoon tablespoons tbsp", "cup": "cup cups", "oz": "ounce ounces oz", "lb": "pound pounds lb lbs", "g": "gram grams g", "kg": "kilogram kilograms kg", "ml": "milliliter milliliters ml", "l": "liter liters l", "clove": "clove cloves", "can": "can cans"}
_UNIT_OF = {x: unit for unit, spellings in UNITS.items() for x in spellings.split()}
_GLYPHS = "".join(FRACTIONS)
_TOKEN = rf"(?:[0-9]+[ \t]+(?:[0-9]+/[0-9]+|[{_GLYPHS}])|[0-9]*[{_GLYPHS}]|[0-9]+/[0-9]+|[0-9]+(?:[.][0-9]+)?)"
AMOUNT = rf"^({_TOKEN})(?:[ \t]*(?:-|–|to)[ \t]*({_TOKEN}))?(.*)$"
_NO_AMOUNT = rf"^(?:[0-9/.{_GLYPHS}]|[ \t]+[0-9{_GLYPHS}])"
# Signs that render as a space or as nothing.
SPACES, NOTHING = "\u00a0\u202f\u2007", "\u200b\u200c\u200d\u2060\ufeff\u00ad"

_SERVED = ("Serves 4", "Yield: 6 to 8 servings", "This recipe serves 2-3.", "makes 4", "Servings 0", "Serves 8 to 4", "(4 servings)", "serves 4 generous or 6 smaller servings", "serves 4 people", "🍽 Serves 2", "Serves: 12", "6 servings!", "no servings", "Serves 4\nor so", "")
_TIMED = ("Prep time: 20 minutes", "cook 1 hour 5 mins", "Total time PT1H30M", "prep PT", "Total: 2 hrs.", "cook time about 20 minutes", "⏲ Prep 5 min", "20 minutes", "Cook time: 90 minutes minutes", "total 1h", "")
_AMOUNTS = ("1 1/2 cups rye flour", "2½ tbsp dill", "3-4 cloves garlic", "1 to 2 cans (400 g) chickpeas", "¾ cup stock", "salt", "1/2/3 cups x", "10 ounces", "▢ 2 lbs leeks", "4 large eggs", "1.5 l milk", "2 ½", "1/0 cup x", "")
_PERIODS = ("Do it every two weeks, or in 10 days.", "1.5 weeks and 2-3 days and half a month", "daily, weekly; each month", "three days 4 weeks", "a week per day", "every 12 months", "fortnight", "")
_HANDLES = ("@plum_jam", " Leek.Soup ", "@@x", "rye-flour_42", "@", "")
_MAPPINGS = ("0:rye flour,salt;2:dill", "1: a ;;3:", "x", "", "4:b,b, c")
_PAGES = ("Plum jam\nServes 4\nIngredients\n2 cups plums\nMethod\nCook.\nYield: 6 jars\nPrep time 10 minutes\ncook time: 1 hour", "Ingredients\nsalt\nservings about 3\nTotal: 5 min\nTotal time: 90 minutes", "no labels here", "yield 2\nx\nIngredients\nserves 3")
_VALUES = ('{"a": ["x", " ", "y"], "n": 3}', '{"a": "one", "n": 3.0}', '{"a": " ", "n": 3.5}', '{"a": 5, "n": true}', '{"a": null, "n": "3"}', '{"n": -12}', "{broken", "[]")


def literals(spark: SparkSession, texts: tuple[str, ...]) -> DataFrame:
    """(id, text) of literal texts, with ids from -1 downwards."""
    return spark.createDataFrame([(-n, x) for n, x in enumerate(texts, 1)], "id long, text string")


def _documents_and(spark: SparkSession, sf_dir: str, texts: tuple[str, ...]) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").union(literals(spark, texts))


def _page_lines_and(spark: SparkSession, sf_dir: str, texts: tuple[str, ...]) -> DataFrame:
    lines = load(spark, sf_dir, "evidence_text").select(F.col("evidence_id").alias("id"), F.explode(F.split("text", "\r?\n")).alias("text"))
    return lines.union(literals(spark, texts))


def _int(column: Column) -> Column:
    return F.nullif(column, F.lit("")).try_cast("long")


def served(column: Column) -> tuple[Column, Column]:
    """Least and most servings that a line states in one of the SERVINGS forms; nulls where it doesn't, or not soundly."""
    bare = F.regexp_replace(column, ICON, "")
    part = lambda n: F.coalesce(*(_int(F.regexp_extract(bare, p, n)) for p in SERVINGS))
    low, high = part(1), F.coalesce(part(2), part(1))
    sound = ~F.contains(column, F.lit("\n")) & (low >= 1) & (low <= high)
    return F.when(sound, low), F.when(sound, high)


def servings_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of page texts that state servings, with the range they state."""
    rows = _page_lines_and(spark, sf_dir, _SERVED)
    low, high = served(F.col("text"))
    return rows.select("id", "text", low.alias("low"), high.alias("high")).filter("low is not null")


def servings_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By first letter of the literal statements of servings: whether they agree, that is, name one range at most and no count outside it."""
    low, high = served(F.col("text"))
    rows = literals(spark, _SERVED).select(F.lower(F.substring("text", 1, 1)).alias("letter"), low.alias("low"), high.alias("high")).filter("low is not null")
    span = F.struct("low", "high")
    of = rows.groupBy("letter").agg(F.countDistinct(F.when(F.col("low") < F.col("high"), span)).alias("ranges"), F.min(F.when(F.col("low") < F.col("high"), span)).alias("r"), F.min(F.when(F.col("low") == F.col("high"), F.col("low"))).alias("least"), F.max(F.when(F.col("low") == F.col("high"), F.col("low"))).alias("most"))
    inside = F.coalesce((F.col("least") >= F.col("r.low")) & (F.col("most") <= F.col("r.high")), F.lit(True))
    return of.select("letter", F.when(F.col("ranges") > 1, False).when(F.col("ranges") == 1, inside).otherwise(F.col("least") == F.col("most")).alias("fits"))


def stated_minutes(column: Column, groups: int = 0, pattern: str = DURATION) -> Column:
    """Minutes of the DURATION that a text matches, of whose groups `groups` come before."""
    part = lambda n: _int(F.regexp_extract(column, pattern, groups + n))
    any_ = F.coalesce(*(part(n) for n in range(1, 6)))
    return F.when(any_.isNotNull(), F.coalesce(part(1), part(4), F.lit(0)) * 60 + F.coalesce(part(2), part(3), part(5), F.lit(0)))


def time_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of page texts that state a time for preparing, cooking or both: the role and the minutes."""
    rows = _page_lines_and(spark, sf_dir, _TIMED).withColumn("bare", F.regexp_replace("text", ICON, ""))
    return rows.select("id", F.lower(F.regexp_extract("bare", TIMES, 1)).alias("role"), stated_minutes(F.col("bare"), 1, TIMES).alias("minutes")).filter("minutes is not null")


def duration_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes that literal durations and document titles name, anywhere in them or as an ISO duration."""
    titles = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("title").alias("text"))
    rows = titles.union(literals(spark, (*_TIMED, "PT2H", "pt45m", "1 hr and 10 minutes")))
    iso, word = r"(?i)^\s*PT(?:([0-9]+)H)?(?:([0-9]+)M)?\s*$", r"(?i)([0-9]+)\s*(?:{})"
    number = lambda p, n: _int(F.regexp_extract("text", p, n))
    hours, minutes = number(word.format("hours?|hrs?"), 1), number(word.format("minutes?|mins?"), 1)
    value = F.when(F.col("text").rlike(iso), F.coalesce(number(iso, 1), F.lit(0)) * 60 + F.coalesce(number(iso, 2), F.lit(0))).when(hours.isNotNull() | minutes.isNotNull(), F.coalesce(hours, F.lit(0)) * 60 + F.coalesce(minutes, F.lit(0)))
    return rows.select("id", value.alias("minutes")).filter("minutes is not null")


def number_of(token: Column) -> Column:
    """The number that an amount's token states, as a whole number, decimal, fraction or both."""
    whole = F.regexp_extract(F.regexp_replace(token, "[0-9]+/[0-9]+", ""), "([0-9]+(?:[.][0-9]+)?)", 1)
    over = F.regexp_extract(token, "([0-9]+)/([0-9]+)", 1).try_cast("double") / F.nullif(F.regexp_extract(token, "([0-9]+)/([0-9]+)", 2).try_cast("double"), F.lit(0.0))
    sign = F.try_element_at(F.create_map(*(F.lit(x) for p in FRACTIONS.items() for x in p)), F.regexp_extract(token, f"([{_GLYPHS}])", 1))
    broken = F.contains(token, F.lit("/")) & over.isNull()
    return F.when((token != "") & ~broken, F.coalesce(whole.try_cast("double"), F.lit(0.0)) + F.coalesce(over, sign, F.lit(0.0)))


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingredient lines (under a heading, and literal ones) as least and greatest amount, unit and item; without a sound amount the whole line is the item."""
    rows = _page_lines_and(spark, sf_dir, _AMOUNTS).withColumn("clean", F.regexp_replace(F.trim(visible("text")), "^[▢☐ ]+", "")).filter(F.col("clean").rlike(rf"^(?:[0-9{_GLYPHS}].{{0,80}}|.{{0,6}})$"))
    rest = F.regexp_extract("clean", AMOUNT, 3)
    sound = F.col("clean").rlike(AMOUNT) & ~rest.rlike(_NO_AMOUNT)
    low, top = F.regexp_extract("clean", AMOUNT, 1), F.regexp_extract("clean", AMOUNT, 2)
    rows = rows.withColumns({"low": F.when(sound, number_of(low)), "high": F.when(sound & (top != ""), number_of(top)), "bad": ~sound | number_of(low).isNull() | ((top != "") & number_of(top).isNull())})
    after = F.trim(F.regexp_replace(F.trim(rest), r"^\([^)]*\)\s*", ""))
    first = F.regexp_extract(after, "^([A-Za-z0-9_]+)", 1)
    unit = F.try_element_at(F.create_map(*(F.lit(x) for p in _UNIT_OF.items() for x in p)), F.lower(first))
    item = F.when(unit.isNotNull(), F.trim(F.substring(after, F.length(first) + 1, F.length(after)))).otherwise(after)
    bad = F.col("bad")
    return rows.select("id", F.when(~bad, F.round("low", 6)).alias("low"), F.when(~bad, F.round("high", 6)).alias("high"), F.when(~bad, unit).alias("unit"), F.when(bad, F.col("clean")).otherwise(item).alias("item"))


_PERIOD = r"(?:^|[^a-z0-9_.,/–-])([0-9]+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|an?)\s+(days?|weeks?|months?)\b"
_NUMBERS = dict(zip("one two three four five six seven eight nine ten eleven twelve a an".split(), [*range(1, 13), 1, 1]))
_REPEATED = r"\b(?:every|each|per)\s+(day|week|month)\b"
_DAYS = {"day": 1, "week": 7, "month": 30}
_ADVERBS = {"daily": 1, "weekly": 7, "monthly": 30}


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All periods that a document supports, in days: whole numbers of days, weeks or months, every/each/per, and adverbs.

    Parts of decimals, ranges and fractions, and halves or quarters, support nothing.
    """
    # a half or quarter is bound to what follows, so that this no longer begins a period
    low = F.regexp_replace(F.lower("text"), r"\b(half|quarter) ", "$1_")
    days = F.create_map(*(F.lit(x) for p in _DAYS.items() for x in p))
    words = F.create_map(*(F.lit(x) for p in _NUMBERS.items() for x in p))
    number = lambda x: F.coalesce(F.try_element_at(words, F.regexp_extract(x, _PERIOD, 1)).cast("long"), F.regexp_extract(x, _PERIOD, 1).try_cast("long"))
    counted = F.transform(F.regexp_extract_all(low, F.lit(_PERIOD), 0), lambda x: number(x) * F.try_element_at(days, F.regexp_extract(x, "(day|week|month)s?$", 1)))
    repeated = F.transform(F.regexp_extract_all(low, F.lit(_REPEATED), 1), lambda x: F.try_element_at(days, x).cast("long"))
    adverbs = F.filter(F.array(*(F.when(low.rlike(rf"\b{w}\b"), F.lit(d).cast("long")) for w, d in _ADVERBS.items())), lambda x: x.isNotNull())
    every = F.concat(counted, repeated, adverbs)
    return _documents_and(spark, sf_dir, _PERIODS).filter("text is not null").select("id", F.array_join(F.transform(every, lambda x: x.cast("string")), ",").alias("days")).filter("days <> ''")


_ROLES = {"servings": "yields?|servings|serves", "prep_time": "prep time|prep", "cook_time": "cook time|cook", "total_time": "total time|total"}
_ROLE_LINE = r"(?i)^\s*(?:{})(?:\s*:\s*|\s+)([0-9].{{0,59}})$"


def role_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page and role the labelled value (from a digit on, 60 characters at most) that stands nearest to the heading of the ingredients."""
    pages = load(spark, sf_dir, "evidence_text").select(F.col("evidence_id").alias("id"), "text").union(literals(spark, _PAGES)).filter("text is not null")
    lines = pages.select("id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    by_page = Window.partitionBy("id")
    lines = lines.withColumn("anchor", F.min(F.when(F.lower(F.trim("line")) == "ingredients", F.col("n"))).over(by_page)).filter("anchor is not null")
    found = F.array(*(F.struct(F.lit(role).alias("role"), F.trim(F.regexp_extract("line", _ROLE_LINE.format(labels), 1)).alias("value")) for role, labels in _ROLES.items()))
    values = lines.select("id", "n", "anchor", F.explode(found).alias("f")).filter("f.value <> ''")
    return values.groupBy("id", F.col("f.role").alias("role")).agg(F.min_by("f.value", F.struct(F.abs(F.col("n") - F.col("anchor")), "n")).alias("value"))


def visible(column: str | Column) -> Column:
    """A text with signs that render as spaces as spaces, and without those that render as nothing."""
    return F.translate(F.translate(column, SPACES, " " * len(SPACES)), NOTHING, "")


def invisible_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, cases and literal texts that hold invisible signs: how many, and the text's length without them."""
    cases = load(spark, sf_dir, "holdout_cases").select(F.col("case_id").alias("key"), F.col("evidence_text").alias("text"))
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), "text").union(cases).union(spark.createDataFrame([("a", "x\u200by\u00a0z"), ("b", "plain")], "key string, text string"))
    kept = F.length(F.translate("text", SPACES + NOTHING, ""))
    return rows.select("key", (F.length("text") - kept).cast("long").alias("signs"), F.length(visible("text")).cast("long").alias("chars")).filter("signs > 0")


def joined_lines(column: str | Column) -> Column:
    """Lines of a visible text as an array, a line that continues a sentence joined to the one before."""
    lines = F.filter(F.transform(F.split(visible(column), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", ""))), lambda x: x != "")
    going = lambda done, x: (F.size(done) > 0) & ~F.coalesce(F.element_at(done, F.lit(-1)), F.lit(".")).rlike("[.!?:;]$") & x.rlike(r"^[a-z0-9,;)\]’'\"-]")
    step = lambda done, x: F.when(going(done, x), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(F.element_at(done, F.lit(-1)), F.lit(" "), x)))).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(lines, F.array().cast("array<string>"), step)


def challenger_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by sentences that also stand in a dev case: found in the text as it is, and in its joined visible lines."""
    key = lambda c: F.filter(F.array_distinct(F.transform(c, sentence_key)), lambda k: F.length(k) >= 12)
    known = load(spark, sf_dir, "dev_cases", "text").select(F.explode(key(sentences("text"))).alias("k")).distinct()
    cases = load(spark, sf_dir, "holdout_cases", "case_id", "evidence_text").filter("evidence_text is not null")
    two = F.array(F.struct(F.lit("baseline").alias("variant"), key(sentences("evidence_text")).alias("ks")), F.struct(F.lit("challenger").alias("variant"), key(sentences(F.array_join(joined_lines("evidence_text"), "\n"))).alias("ks")))
    rows = cases.select("case_id", F.explode(two).alias("v")).select("case_id", "v.variant", F.explode("v.ks").alias("k")).join(known, "k", "left_semi")
    by = rows.groupBy("case_id").agg(F.count_if(F.col("variant") == "baseline").alias("baseline"), F.count_if(F.col("variant") == "challenger").alias("challenger"))
    return by.groupBy(F.signum(F.col("challenger") - F.col("baseline")).cast("long").alias("change")).agg(F.count("*").alias("cases"))


def handle_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles in their normal form (lower case, one @), and as names to read: without @, dots and underscores as blanks, each word capitalised."""
    hosts = load(spark, sf_dir, "publishers").select(F.split_part("host", F.lit("."), F.lit(1)).alias("text")).union(literals(spark, _HANDLES).select("text"))
    bare = F.regexp_replace(F.lower(F.trim("text")), "^@+", "")
    return hosts.filter("text is not null").select(F.concat(F.lit("@"), bare).alias("handle"), F.initcap(F.trim(F.translate(bare, "._", "  "))).alias("name"))


def coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON values as a list of non-blank texts (a text alone is a list of one) and as a strict whole number, not of booleans, texts or fractions."""
    docs = load(spark, sf_dir, "holdout_cases").select(F.regexp_replace(F.col("document"), '"unknown_fields"', '"a"').alias("text")).union(literals(spark, _VALUES).select("text"))
    v = docs.select("text", F.try_parse_json("text").alias("v")).select("text", F.try_variant_get("v", "$.a", "array<string>").alias("list"), F.try_variant_get("v", "$.a", "string").alias("one"), F.schema_of_variant(F.try_variant_get("v", "$.a", "variant")).alias("kind"), F.try_variant_get("v", "$.n", "double").alias("n"), F.schema_of_variant(F.try_variant_get("v", "$.n", "variant")).alias("n_kind"))
    filled = lambda xs: F.filter(xs, lambda x: F.trim(x) != "")
    items = F.when(F.col("kind").startswith("ARRAY"), filled("list")).when(F.col("kind") == "STRING", filled(F.array("one"))).otherwise(F.array().cast("array<string>"))
    number = F.when(F.col("n_kind").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.col("n") == F.floor("n")), F.col("n").cast("long"))
    return v.groupBy(F.array_join(items, "|").alias("items"), number.alias("number")).agg(F.count("*").alias("documents"))


def mapped_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of number and name in texts like 0:rye flour,salt;2:dill, trimmed, in lower case, without repeats or empty ones."""
    entry = literals(spark, _MAPPINGS).select("id", F.explode(F.split("text", ";")).alias("e")).filter(F.col("e").rlike("^ *[0-9]+ *:"))
    pairs = entry.select("id", F.trim(F.split_part("e", F.lit(":"), F.lit(1))).cast("long").alias("n"), F.explode(F.split(F.split_part("e", F.lit(":"), F.lit(2)), ",")).alias("name"))
    return pairs.select("id", "n", F.lower(F.trim("name")).alias("name")).filter("name <> ''").distinct()


QUERIES = {f.__name__: f for f in (servings_quotes, servings_fit, time_quotes, duration_minutes, amounts, periods, role_lines, invisible_signs, challenger_matches, handle_names, coerced_values, mapped_tokens)}


def text_sql(text: str) -> str:
    """A text as a DuckDB literal."""
    return "E'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"


def _rows_sql(texts: tuple[str, ...]) -> str:
    return f"select -generate_subscripts(x, 1) as id, unnest(x) as text from (select [{', '.join(map(text_sql, texts))}] as x)"


def _case_sql(column: str, of: dict) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v!r}" for k, v in of.items()) + " end"


_bare = text_sql(ICON)
_x = lambda c, p, n: f"try_cast(nullif(regexp_extract({c}, {text_sql(p)}, {n}), '') as bigint)"
_page = lambda texts: f"(select evidence_id as id, unnest(string_split_regex(text, '\\r?\\n')) as text from evidence_text union all {_rows_sql(texts)})"
_SERVED_SQL = f"select id, text, case when ok then low end as low, case when ok then high end as high from (select *, not contains(text, chr(10)) and low >= 1 and low <= high as ok from (select id, text, l as low, coalesce(h, l) as high from (select id, text, coalesce({', '.join(_x('b', p, 1) for p in SERVINGS)}) as l, coalesce({', '.join(_x('b', p, 2) for p in SERVINGS)}) as h from (select *, regexp_replace(text, {_bare}, '') as b from {{}}))))"
_NUM_SQL = f"case when {{t}} <> '' and not (contains({{t}}, '/') and coalesce(try_cast(regexp_extract({{t}}, '([0-9]+)/([0-9]+)', 2) as double), 0) = 0) then coalesce(try_cast(regexp_extract(regexp_replace({{t}}, '[0-9]+/[0-9]+', '', 'g'), '([0-9]+(?:[.][0-9]+)?)', 1) as double), 0) + coalesce(try_cast(regexp_extract({{t}}, '([0-9]+)/([0-9]+)', 1) as double) / nullif(try_cast(regexp_extract({{t}}, '([0-9]+)/([0-9]+)', 2) as double), 0), {_case_sql(f'regexp_extract({{t}}, {text_sql(f"([{_GLYPHS}])")}, 1)', FRACTIONS)}, 0) end"
_num = lambda t: _NUM_SQL.replace("{t}", t)
_KEYS = r"""list_filter(list_distinct(list_transform({}, lambda s: regexp_replace(lower(trim(regexp_replace(translate(s, '‘’“”', '''''""'), '[ \t\r\n]+', ' ', 'g'))), '\.$', ''))), lambda k: length(k) >= 12)"""
_SENT = r"list_filter(string_split(regexp_replace(regexp_replace({}, '([.!?])[ \n]+', '\1␞', 'g'), '\n+', '␞', 'g'), '␞'), lambda s: trim(s) <> '')"
_SEEN = f"translate(translate({{}}, {text_sql(SPACES)}, '{' ' * len(SPACES)}'), {text_sql(NOTHING)}, '')"
_JOIN = r"""list_reduce(list_filter(list_transform(string_split({}, chr(10)), lambda x: trim(regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g'))), lambda x: x <> ''), lambda a, x: a || case when not regexp_matches(a, '[.!?:;]$') and regexp_matches(x, '^[a-z0-9,;)\]’''"-]') then ' ' else chr(10) end || x)"""
_D = text_sql(_PERIOD)
_DAY_SQL = "case {} when 'day' then 1 when 'week' then 7 else 30 end"
SQL = {
    "servings_quotes": f"select * from ({_SERVED_SQL.replace('{}', _page(_SERVED))}) where low is not null",
    "servings_fit": f"with s as (select lower(text[1]) as letter, low, high from ({_SERVED_SQL.replace('{}', '(' + _rows_sql(_SERVED) + ')')}) where low is not null), r as (select letter, count(distinct (low, high)) filter (low < high) as ranges, min(low) filter (low < high) as rl, max(high) filter (low < high) as rh, min(low) filter (low = high) as least, max(low) filter (low = high) as most from s group by 1) select letter, case when ranges > 1 then false when ranges = 1 then coalesce(least >= rl and most <= rh, true) else least = most end as fits from r",
    "time_quotes": f"select id, role, coalesce(h, ih, 0) * 60 + coalesce(m, m2, im, 0) as minutes from (select id, lower(regexp_extract(b, {text_sql(TIMES)}, 1)) as role, {', '.join(_x('b', TIMES, n + 2) + ' as ' + a for n, a in enumerate(('h', 'm', 'm2', 'ih', 'im')))} from (select id, regexp_replace(text, {_bare}, '') as b from {_page(_TIMED)})) where coalesce(h, m, m2, ih, im) is not null",
    "duration_minutes": f"select * from (select id, case when regexp_matches(text, '(?i)^\\s*PT(?:([0-9]+)H)?(?:([0-9]+)M)?\\s*$') then coalesce({_x('text', r'(?i)^\s*PT(?:([0-9]+)H)?(?:([0-9]+)M)?\s*$', 1)}, 0) * 60 + coalesce({_x('text', r'(?i)^\s*PT(?:([0-9]+)H)?(?:([0-9]+)M)?\s*$', 2)}, 0) when h is not null or m is not null then coalesce(h, 0) * 60 + coalesce(m, 0) end as minutes from (select id, text, {_x('text', r'(?i)([0-9]+)\s*(?:hours?|hrs?)', 1)} as h, {_x('text', r'(?i)([0-9]+)\s*(?:minutes?|mins?)', 1)} as m from (select doc_id as id, title as text from documents union all {_rows_sql((*_TIMED, 'PT2H', 'pt45m', '1 hr and 10 minutes'))}))) where minutes is not null",
    "amounts": f"with c as (select id, regexp_replace(trim({_SEEN.format('text')}), '^[▢☐ ]+', '') as c from {_page(_AMOUNTS)}), m as (select id, c, regexp_matches(c, {text_sql(AMOUNT)}) as hit, regexp_extract(c, {text_sql(AMOUNT)}, 1) as l, regexp_extract(c, {text_sql(AMOUNT)}, 2) as h, regexp_extract(c, {text_sql(AMOUNT)}, 3) as rest from c where regexp_matches(c, {text_sql(rf'^(?:[0-9{_GLYPHS}].{{0,80}}|.{{0,6}})$')})), n as (select *, hit and not regexp_matches(rest, {text_sql(_NO_AMOUNT)}) as sound, {_num('l')} as low, {_num('h')} as high, trim(regexp_replace(trim(rest), '^\\([^)]*\\)\\s*', '')) as after from m), u as (select *, not sound or low is null or (h <> '' and high is null) as bad, regexp_extract(after, '^([A-Za-z0-9_]+)', 1) as first from n), v as (select *, {_case_sql('lower(first)', _UNIT_OF)} as un from u) select id, case when not bad then round(low, 6) end as low, case when not bad then round(high, 6) end as high, case when not bad then un end as unit, case when bad then c when un is not null then trim(substring(after, length(first) + 1)) else after end as item from v",
    "periods": f"with t as (select id, regexp_replace(lower(text), '\\b(half|quarter) ', '\\1_', 'g') as t from (select doc_id as id, text from documents union all {_rows_sql(_PERIODS)}) where text is not null) select * from (select id, array_to_string(list_concat(list_transform(regexp_extract_all(t, {_D}), lambda x: coalesce({_case_sql(f'regexp_extract(x, {_D}, 1)', _NUMBERS)}, try_cast(regexp_extract(x, {_D}, 1) as bigint)) * {_DAY_SQL.format(chr(114) + 'egexp_extract(x, ' + text_sql('(day|week|month)s?$') + ', 1)')}), list_transform(regexp_extract_all(t, {text_sql(_REPEATED)}, 1), lambda x: {_DAY_SQL.format('x')}), list_filter([{', '.join(f'case when regexp_matches(t, {text_sql(chr(92) + chr(98) + w + chr(92) + chr(98))}) then {d} end' for w, d in _ADVERBS.items())}], lambda x: x is not null)), ',') as days from t) where days <> ''",
    "role_lines": f"with p as (select evidence_id as id, text from evidence_text union all {_rows_sql(_PAGES)}), l as (select id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from p where text is not null), a as (select *, min(n) filter (lower(trim(line)) = 'ingredients') over (partition by id) as anchor from l), f as (select id, n, anchor, unnest(['servings', 'prep_time', 'cook_time', 'total_time']) as role, trim(unnest([{', '.join(f'regexp_extract(line, {text_sql(_ROLE_LINE.format(x))}, 1)' for x in _ROLES.values())}])) as value from a where anchor is not null) select id, role, arg_min(value, (abs(n - anchor), n)) as value from f where value <> '' group by id, role",
    "invisible_signs": f"select key, signs, length({_SEEN.format('text')}) as chars from (select key, text, length(text) - length(translate(text, {text_sql(SPACES + NOTHING)}, '')) as signs from (select doc_id::varchar as key, text from documents union all select case_id, evidence_text from holdout_cases union all select * from (values ('a', {text_sql('x' + chr(0x200B) + 'y' + chr(0xA0) + 'z')}), ('b', 'plain')) v(key, text))) where signs > 0",
    "challenger_matches": f"with d as (select distinct unnest({_KEYS.format(_SENT.format('text'))}) as k from dev_cases), h as (select case_id, 'b' as v, unnest({_KEYS.format(_SENT.format('evidence_text'))}) as k from holdout_cases where evidence_text is not null union all select case_id, 'c', unnest({_KEYS.format(_SENT.format('j'))}) from (select case_id, {_JOIN.format(_SEEN.format('evidence_text'))} as j from holdout_cases where evidence_text is not null and trim(evidence_text) <> '')), c as (select case_id, count(*) filter (v = 'b') as b, count(*) filter (v = 'c') as c from h where k in (from d) group by 1) select sign(c - b)::bigint as change, count(*) as cases from c group by 1",
    "handle_names": f"select '@' || b as handle, array_to_string(list_transform(string_split(trim(translate(b, '._', '  ')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as name from (select regexp_replace(lower(trim(text)), '^@+', '') as b from (select split_part(host, '.', 1) as text from publishers union all select text from ({_rows_sql(_HANDLES)})) where text is not null)",
    "coerced_values": f"with j as (select try_cast(text as json) as j from (select replace(document, '\"unknown_fields\"', '\"a\"') as text from holdout_cases union all select text from ({_rows_sql(_VALUES)}))), k as (select j->'$.a' as a, coalesce(json_type(j->'$.a'), '') as a_type, coalesce(json_type(j->'$.n'), '') as nt, try_cast(j->>'$.n' as double) as n, j->>'$.a' as one from j) select array_to_string(list_filter(case when a_type = 'ARRAY' then from_json(a, '[\"varchar\"]') when a_type = 'VARCHAR' then [one] else [] end, lambda x: trim(x) <> ''), '|') as items, case when nt in ('UBIGINT', 'BIGINT', 'DOUBLE') and n = floor(n) then n::bigint end as number, count(*) as documents from k group by 1, 2",
    "mapped_tokens": f"with e as (select id, unnest(string_split(text, ';')) as e from ({_rows_sql(_MAPPINGS)})), p as (select id, trim(split_part(e, ':', 1))::bigint as n, lower(trim(unnest(string_split(split_part(e, ':', 2), ',')))) as name from e where regexp_matches(e, '^ *[0-9]+ *:')) select distinct * from p where name <> ''",
}
