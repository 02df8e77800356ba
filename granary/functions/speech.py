"""Texts as they are read aloud. A text is cut into tokens, each token is spoken by its kind, and the rest stays as it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and months that are spoken.
WORDS = {
    "en": {"rupees": "rupees", "quintal": "per quintal", "to": "to", "percent": "percent", "plus": "plus", "minus": "minus"},
    "hi": {"rupees": "रुपये", "quintal": "प्रति क्विंटल", "to": "से", "percent": "प्रतिशत", "plus": "प्लस", "minus": "माइनस"},
    "mr": {"rupees": "रुपये", "quintal": "प्रति क्विंटल", "to": "ते", "percent": "टक्के", "plus": "प्लस", "minus": "वजा"},
}
MONTHS = {
    "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
    "hi": ("जनवरी", "फ़रवरी", "मार्च", "अप्रैल", "मई", "जून", "जुलाई", "अगस्त", "सितंबर", "अक्टूबर", "नवंबर", "दिसंबर"),
    "mr": ("जानेवारी", "फेब्रुवारी", "मार्च", "एप्रिल", "मे", "जून", "जुलै", "ऑगस्ट", "सप्टेंबर", "ऑक्टोबर", "नोव्हेंबर", "डिसेंबर"),
}
MOST = 1000

COIN = r"(?:₹|\bRs\b\.?|\bINR\b)"
#: A number whose commas are thousands separators, with groups of two or three digits before the last three; or one without.
NUMBER = r"(?:\d{1,3}(?:,\d{2,3})*,\d{3}(?!\d)|\d+)(?:\.\d+)?"
QUINTAL = r"(?:quintal|qtl|क्विंटल)(?![\p{L}\p{M}])"
#: The kinds of tokens in the order in which they are looked for.
KINDS = {
    "silent": r"<[^>]*>|https?://\S+|[*_`#>•]+|[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]",
    "date": r"\b\d{4}-(?:0[1-9]|1[0-2])-\d{2}\b",
    "range": rf"{COIN}\s?{NUMBER}\s*(?:-|–|—|to)\s*{COIN}?\s?{NUMBER}",
    "money": rf"{COIN}\s?{NUMBER}",
    "coin": rf"{COIN}(?=\s*(?:/|per\b))",
    "unit": rf"\s*/\s*{QUINTAL}",
    "signed": rf"(?<![^\s(*_`#>•])[+\-−]\s?{NUMBER}",
    "percent": r"(?<=\d)\s?%",
    "number": NUMBER,
    "rest": r"[\p{L}\p{M}]+|\s+|.",
}


def speech(text: Column, language: str = "en", most: int = MOST) -> Column:
    """No markup, links or signs; dates, amounts, ranges, units, signs and percents in words; thousands without commas.

    A comma that doesn't separate thousands stays ("7,8 days"). Longer texts end at a word, with an ellipsis, within most characters. Null is empty.
    """
    words, months = WORDS.get(language, WORDS["en"]), MONTHS.get(language, MONTHS["en"])
    token = F.lit("(?iu)" + "|".join(KINDS.values()))

    def spoken(x: Column) -> Column:
        is_a = lambda kind: x.rlike(f"(?iu)^(?:{KINDS[kind]})$")
        numbers = F.transform(F.regexp_extract_all(x, F.lit(NUMBER), 0), lambda n: F.replace(n, F.lit(","), F.lit("")))
        say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        date = F.concat_ws(" ", F.substring(x, 9, 2).cast("int").cast("string"), F.get(F.array(*map(F.lit, months)), F.substring(x, 6, 2).cast("int") - 1), F.substring(x, 1, 4))
        return (
            F.when(is_a("silent"), " ").when(is_a("date"), date)
            .when(is_a("range"), say(F.get(numbers, 0), f" {words['to']} ", F.get(numbers, 1), f" {words['rupees']}"))
            .when(is_a("money"), say(F.get(numbers, 0), f" {words['rupees']}")).when(x.rlike(f"(?iu)^{COIN}$"), words["rupees"]).when(is_a("unit"), f" {words['quintal']}")
            .when(x.rlike(rf"^\+\s?{NUMBER}$"), say(f"{words['plus']} ", F.get(numbers, 0))).when(x.rlike(rf"^[\-−]\s?{NUMBER}$"), say(f"{words['minus']} ", F.get(numbers, 0)))
            .when(x.rlike(r"^\s?%$"), f" {words['percent']}").when(is_a("number"), F.get(numbers, 0)).otherwise(x)
        )

    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), token, 0)
    joined = F.array_join(F.transform(tokens, spoken), "")
    out = F.trim(F.regexp_replace(F.regexp_replace(joined, r"\s+", " "), r" +([,.;:!?।)])", "$1"))
    short = F.regexp_replace(F.substring(out, 1, most - 1), r"\s+\S*$", "")
    return F.when(F.length(out) > most, F.concat(short, F.lit("…"))).otherwise(out)
