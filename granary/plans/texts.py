"""Queries over what is said: all turns of the conversations as they are, and after each of them a question from a fixed list."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import texts as t
from granary.functions.speech import speech
from granary.operators import talks
from granary.plans.registry import query
from granary.sources import prices as p

QUESTIONS = (
    "onion price", "what about Nashik", "will it go up tomorrow", "कांद्याचा भाव काय आहे", "is it risky to sell tomato", "which mandi is best for sweet potatoes", "thanks", "my onion leaves are turning yellow and I do not know why",
    "should i sell now or wait 3 days", "how reliable is the forecast", "wheat trend last month in Pune", "what is msp", "hello", "आलू का भाव ₹1,400 - ₹1,600", "potato?", "बाजार १४०० रुपये", "day after tomorrow", "corn 1,250.5 and 7 days",
)


def turns(spark, d, *more):
    """The turns, numbered by even numbers, and a question of the list after each, numbered by the odd ones. more: role, whose questions are the user's."""
    k = (F.col("conv_id") * 7 + F.col("turn")) % len(QUESTIONS)
    said = F.array(F.struct((F.col("turn") * 2).alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")), F.struct((F.col("turn") * 2 + 1).alias("turn"), F.lit("user").alias("role"), F.element_at(F.array(*map(F.lit, QUESTIONS)), (k + 1).cast("int")).alias("text")))
    return p.table(spark, d, "conversations").select("conv_id", F.explode(said).alias("s")).select("conv_id", "s.turn", "s.text", *[f"s.{n}" for n in more])


def plain(words, stems=()) -> str:
    """The pattern without lookaround: a neighbour that is no letter or mark, or the text's edge."""
    parts = [f"(^|[^\\p{{L}}\\p{{M}}])(?:{'|'.join(words)})($|[^\\p{{L}}\\p{{M}}])"] if words else []
    return ("(?i)" + "|".join(parts + ([f"(^|[^\\p{{L}}\\p{{M}}])(?:{'|'.join(stems)})"] if stems else []))).replace("'", "''")


def says(c: str, what) -> str:
    return f"regexp_matches({c}, '{plain(*what)}')"


def first(c: str, named) -> str:
    return "CASE " + " ".join(f"WHEN {says(c, (w, s))} THEN '{n}'" for n, w, s in named) + " END"


EDGE = "($|[^\\p{L}\\p{M}])"
_DAYS = f"regexp_extract(text, '(?i)(?:^|[^\\p{{L}}\\p{{M}}])([1-7])\\s*(?:-\\s*)?(?:days?|दिन|दिवस)(?:$|[^\\p{{L}}\\p{{M}}])', 1)"
TURNS = f"""
turns AS (SELECT conv_id, turn * 2 AS turn, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT conv_id, turn * 2 + 1, [{", ".join(f"'{x}'" for x in QUESTIONS)}][CAST((conv_id * 7 + turn) % {len(QUESTIONS)} + 1 AS INTEGER)] FROM conversations),
own AS (SELECT *, {first("text", t.CROPS)} AS crop_here, {first("text", t.PLACES)} AS place_here FROM turns),
heard AS (SELECT *, last_value(crop_here IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS crop, last_value(place_here IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM own),
understood AS (
  SELECT conv_id, turn, crop, place, CASE WHEN {says("text", t.DAY_AFTER)} THEN 2 WHEN {_DAYS} <> '' THEN CAST({_DAYS} AS INTEGER) WHEN {says("text", t.TOMORROW)} THEN 1 END AS horizon,
    CASE WHEN regexp_matches(text, '(?i){t.EDUCATION}') THEN 'MARKET_EDUCATION' WHEN {says("text", t.RECOMMEND)} THEN 'RECOMMENDATION_EXPLANATION' WHEN {says("text", t.UNCERTAINTY)} AND ({says("text", t.FORECAST)} OR regexp_matches(text, '(?i)interval|अंदाज|खात्री')) THEN 'FORECAST_UNCERTAINTY'
         WHEN {says("text", t.SELL)} THEN 'SELL_TIMING' WHEN {says("text", t.RISK)} THEN 'RISK_EXPLANATION' WHEN {says("text", t.FORECAST)} THEN 'FORECAST' WHEN {says("text", t.HISTORY)} THEN 'PRICE_HISTORY' WHEN {says("text", t.PRICE)} THEN 'LATEST_PRICE'
         WHEN (len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) <= 4 AND (crop_here IS NOT NULL OR place_here IS NOT NULL)) OR (regexp_matches(text, '(?i){t.FOLLOW_UP}{EDGE}') AND (crop IS NOT NULL OR place IS NOT NULL)) THEN 'LATEST_PRICE'
         WHEN regexp_matches(text, '(?i){t.GREETING}{EDGE}') OR {says("text", t.SMALL_TALK)} THEN 'GENERAL_GREETING' ELSE 'CLARIFICATION' END AS intent FROM heard)"""


@query(f"WITH {TURNS} SELECT * FROM understood", obs=False)
def entity_carry_forward(spark, d):
    return talks.understood(turns(spark, d))


#: A conversation's profile is that of the customer of its number: a crop unless it is divisible by 3, a place unless by 4.
CROP_NAMES, PLACE_NAMES = ([n for n, _, _ in named] for named in (t.CROPS, t.PLACES))
LISTED = lambda names, k: f"[{', '.join(repr(n) for n in names)}][CAST({k} % {len(names)} + 1 AS INTEGER)]"
SAID = TURNS.replace("FROM conversations\n", "FROM conversations WHERE role = 'user'\n").replace("ROWS BETWEEN UNBOUNDED PRECEDING", f"ROWS BETWEEN {talks.REMEMBERED} PRECEDING")
ASKS = f"intent IN {talks.DATA_INTENTS}"


@query(f"""WITH {SAID}, profiles AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN {LISTED(CROP_NAMES, "c_custkey")} END AS profile_crop, CASE WHEN c_custkey % 4 <> 0 THEN {LISTED(PLACE_NAMES, "c_custkey")} END AS profile_place FROM customer)
SELECT conv_id, turn, intent, coalesce(crop, CASE WHEN {ASKS} THEN profile_crop END) AS crop, coalesce(place, CASE WHEN {ASKS} THEN profile_place END) AS place,
  concat_ws(',', CASE WHEN {ASKS} AND crop IS NULL AND profile_crop IS NOT NULL THEN 'crop_from_profile' END, CASE WHEN {ASKS} AND place IS NULL AND profile_place IS NOT NULL THEN 'place_from_profile' END) AS assumed
FROM understood LEFT JOIN profiles ON c_custkey = conv_id""", obs=False)
def profiled_entities(spark, d):
    key = F.col("c_custkey")
    pick = lambda names, k: F.when(key % k != 0, F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int")))
    profiles = p.table(spark, d, "customer").select(key.alias("conv_id"), pick(CROP_NAMES, 3).alias("profile_crop"), pick(PLACE_NAMES, 4).alias("profile_place"))
    return talks.remembered(turns(spark, d, "role"), profiles)


@query(f"WITH {TURNS} SELECT intent, count(*) AS turns, count(DISTINCT conv_id) AS conversations FROM understood GROUP BY intent", obs=False)
def intent_counts(spark, d):
    return talks.understood(turns(spark, d)).groupBy("intent").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"))


@query(f"WITH {TURNS.split('own AS')[0]} said AS (SELECT coalesce(text, '') AS text, 'document' AS kind FROM documents UNION ALL SELECT text, 'turn' FROM turns) SELECT kind, crop, count(*) AS texts FROM (SELECT kind, {first('text', t.CROPS)} AS crop FROM said) GROUP BY kind, crop", obs=False)
def crop_detection(spark, d):
    """Crops that whole documents and turns name."""
    said = p.table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("text"), F.lit("document").alias("kind")).unionByName(turns(spark, d).select("text", F.lit("turn").alias("kind")))
    return said.groupBy("kind", t.crop(F.col("text")).alias("crop")).agg(F.count("*").alias("texts"))


@query("""WITH n AS (SELECT conv_id, turn, regexp_extract_all(regexp_replace(translate(text, '०१२३४५६७८९', '0123456789'), '(\\d),(\\d{2,3})', '\\1\\2', 'g'), '\\d+(?:\\.\\d+)?') AS n FROM (SELECT conv_id, turn, text FROM turns))
SELECT conv_id, turn, len(n) AS numbers, list_sum(list_transform(n, lambda x: CAST(x AS DOUBLE))) AS total FROM n WHERE len(n) > 0""".replace("WITH n", f"WITH {TURNS.split('own AS')[0].rstrip().rstrip(',')}, n"), obs=False)
def number_extraction(spark, d):
    found = turns(spark, d).select("conv_id", "turn", t.numbers(F.col("text")).alias("n")).filter(F.size("n") > 0)
    return found.select("conv_id", "turn", F.size("n").alias("numbers"), F.aggregate("n", F.lit(0.0), lambda a, x: a + x).alias("total"))


def answer_grounding(spark, d):
    """The newest price of each series told rightly, rounded, and wrongly: what the check finds."""
    from granary.operators import market as m

    latest = m.latest(p.observations(spark, d)).select("observation_id", "modal_price")
    k = F.conv(F.substring("observation_id", 1, 4), 16, 10).cast("long") % 3
    said = F.when(k == 0, F.col("modal_price")).when(k == 1, F.floor(F.col("modal_price")).cast("double")).otherwise(F.col("modal_price") * 1.5 + 100)
    answer = F.concat(F.lit("In 2 markets the price is ₹"), F.format_number(said, 1), F.lit(" per quintal."))
    return latest.select("observation_id", (F.size(t.ungrounded(answer, F.array("modal_price"))) == 0).alias("grounded"))


query("SELECT observation_id, CAST(('0x' || substr(observation_id, 1, 4)) AS BIGINT) % 3 <> 2 AS grounded FROM (SELECT *, row_number() OVER (PARTITION BY mandi_id, commodity, variety ORDER BY reported_date DESC, observation_id DESC) AS place FROM obs) WHERE place = 1")(answer_grounding)


@query()
def speech_text(spark, d):
    return turns(spark, d).select("conv_id", "turn", speech(F.col("text")).alias("spoken"))


PLACES_ASKED = """asked AS (SELECT conv_id * 1000 + turn * 2 AS text_id, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT conv_id * 1000 + turn * 2 + 1, 'prices in ' || CASE WHEN turn % 3 = 0 THEN 'NATION_' || CAST(conv_id % 30 AS VARCHAR) WHEN turn % 3 = 1 THEN 'Asia now' ELSE 'nowhere' END FROM conversations)"""


@query(f"""WITH {PLACES_ASKED}, runs AS (SELECT text_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: x <> '') AS w FROM asked),
names AS (SELECT lower(n_name) AS alias, n_name AS market, r_name AS district FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT lower(r_name), n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
known AS (SELECT alias, CASE WHEN count(DISTINCT market) = 1 THEN min(market) END AS market, min(district) AS district FROM names GROUP BY alias),
words AS (SELECT text_id, w, unnest(generate_series(1, len(w))) AS i FROM runs WHERE len(w) > 0),
said AS (SELECT DISTINCT text_id, alias FROM (SELECT text_id, unnest([array_to_string(w[i:least(i + k, len(w))], ' ') FOR k IN [0, 1, 2, 3] IF i + k <= len(w)]) AS alias FROM words)),
hits AS (SELECT text_id, said.alias AS alias, market, district FROM said JOIN known ON said.alias = known.alias)
SELECT text_id, alias, market, district FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY length(alias) DESC, alias DESC) AS k FROM hits) WHERE k = 1""", obs=False)
def place_detection(spark, d):
    """Places that all turns, and a planted sentence after each, name. Aliases are the markets' names, and the regions' for all their markets."""
    k = F.col("turn") % 3
    planted = F.concat(F.lit("prices in "), F.when(k == 0, F.concat(F.lit("NATION_"), (F.col("conv_id") % 30).cast("string"))).when(k == 1, "Asia now").otherwise("nowhere"))
    number = F.col("conv_id") * 1000 + F.col("turn") * 2
    asked = p.table(spark, d, "conversations").select(F.explode(F.array(F.struct(number.alias("text_id"), F.col("text")), F.struct((number + 1).alias("text_id"), planted.alias("text")))).alias("s")).select("s.*")
    places = p.table(spark, d, "nation").join(p.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    aliases = places.select(F.col("n_name").alias("alias"), F.col("n_name").alias("market"), F.col("r_name").alias("district")).unionByName(places.select(F.col("r_name").alias("alias"), F.col("n_name").alias("market"), F.col("r_name").alias("district")))
    return talks.named_places(asked, aliases)
