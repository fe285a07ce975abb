"""Text functions as Column expressions: normalising, tokens, segments, quote spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions import rules

SPACE = r"(?U)[\s\x1c-\x1f]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def casefold(c: Column | str) -> Column:
    return F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))


def collapsed(c: Column | str) -> Column:
    """Case-folded, white space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(casefold(c), SPACE + "+", " "))


def normalized(c: Column | str) -> Column:
    """Page text: no NUL, LF line ends, lines trimmed at the right, the whole trimmed, at most one empty line."""
    steps = (("\\x00", ""), ("\r\n|\r", "\n"), (r"(?U)[^\S\n]+(?=\n|\z)", ""), (rf"\A{SPACE}+|{SPACE}+\z", ""), ("\n{3,}", "\n\n"))
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, col(c))


def stripped(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"\A{SPACE}+|{SPACE}+\z", "")


def found(c: Column | str, pattern: str, fold: bool = True, dotall: bool = False) -> Column:
    return F.rlike(col(c), F.lit(rules.spark(pattern, fold, dotall)))


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(rules.TOKEN), 0)


def lexical_tokens(c: Column | str) -> Column:
    """Case-folded tokens of three characters and more that are no stop words, first occurrences in order."""
    kept = F.filter(words(c), lambda t: F.length(t) >= 3)
    return F.array_distinct(F.filter(F.transform(kept, casefold), lambda t: ~t.isin(*rules.LEXICAL_STOP)))


#: Forms of lexemes of full text, the first that fits counts: mail address, host with a path or without, hyphenated word, word, number.
HOST = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
LEXEME = (
    r"[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|" + HOST + r"(?:/[^\s<>\"]*)?|"
    r"\p{L}[\p{L}\p{N}]*(?:-[\p{L}\p{N}]+)+|\p{N}*\p{L}[\p{L}\p{N}]*|[+-]?[0-9]+(?:\.[0-9]+)*(?:[eE][+-]?[0-9]+)?"
)


def simple_lexemes(c: Column | str) -> Column:
    """The lexemes of full text in order, lower-cased, as a parser with a dictionary that changes nothing gives them.

    Numbers with sign, fraction and exponent, mail addresses and hosts are one lexeme each; a host with a path is
    three (the whole, the host, the path); a hyphenated word is itself and then its parts.
    """
    def spread(t: Column) -> Column:
        host = F.regexp_extract(t, f"^({HOST})/", 1)
        url = F.when((host != "") & ~F.contains(t, F.lit("@")), F.array(t, host, F.substr(t, F.length(host) + 1)))
        word = F.when(F.rlike(t, F.lit(r"^\p{L}[\p{L}\p{N}]*(-[\p{L}\p{N}]+)+$")), F.concat(F.array(t), F.split(t, "-")))
        return F.coalesce(url, word, F.array(t))

    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(LEXEME), 0), lambda t: spread(F.lower(t))))


def lexical_query(c: Column | str) -> Column:
    return F.array_join(lexical_tokens(c), " | ")


def qa_terms(c: Column | str) -> Column:
    """Six-character prefixes of the tokens that count for questions."""
    kept = F.filter(words(casefold(c)), lambda t: (F.length(t) >= 3) & ~t.isin(*rules.QA_STOP))
    return F.array_distinct(F.transform(kept, lambda t: F.left(t, F.lit(6))))


def rerank_tokens(c: Column | str) -> Column:
    """Distinct words of over two characters."""
    return F.array_distinct(F.regexp_extract_all(casefold(c), F.lit(r"[\p{L}\p{N}_]{3,}"), 0))


def ochiai(a: Column, b: Column) -> Column:
    """Shared tokens over the geometric mean of the set sizes; 0 if either is empty."""
    size = F.size(a) * F.size(b)
    return F.when(size > 0, F.size(F.array_intersect(a, b)) / F.sqrt(size.cast("double"))).otherwise(F.lit(0.0))


def qa_segments(c: Column | str) -> Column:
    """Sentences that end in . ! ? ; before white space or the end, stripped."""
    return F.transform(F.regexp_extract_all(stripped(c), F.lit(r"(?sUd).+?(?:[.!?;](?=\s|\z)|\z)"), 0), stripped)


def analysis_pieces(c: Column | str) -> Column:
    """Pieces that tile the text: as sentences, but line feeds end them, too."""
    return F.regexp_extract_all(col(c), F.lit(r"(?sUd).+?(?:[.!?;](?=\s|\z)|\n|\z)"), 0)


def analysis_spans(c: Column | str) -> Column:
    """array<struct<quote, lo, hi>> of the non-empty pieces, trimmed; offsets in code points from 0, half open.

    Each piece is trimmed once: a lambda's argument is a value, while a column that is used again is evaluated again.
    """
    led = F.transform(analysis_pieces(c), lambda p: F.struct(F.length(p).alias("n"), F.regexp_replace(p, rf"\A{SPACE}+", "").alias("rest")))
    cut = F.transform(led, lambda p: F.struct(p["n"], F.length(p["rest"]).alias("left"), F.regexp_replace(p["rest"], rf"{SPACE}+\z", "").alias("quote")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<quote:string,lo:int,hi:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        lo = acc["at"] + p["n"] - p["left"]
        span = F.struct(p["quote"].alias("quote"), lo.alias("lo"), (lo + F.length(p["quote"])).alias("hi"))
        return F.struct((acc["at"] + p["n"]).alias("at"), F.when(F.length(p["quote"]) > 0, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(cut, zero, step, lambda acc: acc["out"])


def escaped(token: Column) -> Column:
    return F.regexp_replace(token, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def quote_span(source: Column | str, quote: Column | str) -> Column:
    """struct<lo, hi> of the quote in source, exactly or else with any white space between its words; null if it isn't there."""
    source, quote = col(source), col(quote)
    tokens = F.filter(F.split(quote, SPACE + "+"), lambda t: t != "")
    loose = F.regexp_substr(source, F.concat(F.lit("(?U)"), F.array_join(F.transform(tokens, escaped), r"\s+")))
    exact = F.instr(source, quote)
    at = F.when(exact > 0, exact - 1).when((F.size(tokens) > 0) & loose.isNotNull(), F.instr(source, loose) - 1)
    size = F.when(exact > 0, F.length(quote)).otherwise(F.length(loose))
    return F.when(at.isNotNull(), F.struct(at.alias("lo"), (at + size).alias("hi")))


def contains_normalized(text: Column | str, part: Column | str) -> Column:
    return F.contains(collapsed(text), collapsed(part))


def html_escaped(c: Column | str) -> Column:
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")), col(c))


def html_safe(c: Column | str) -> Column:
    """Escaped for text between tags: quotes stay."""
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), col(c))


def wrapped(c: Column | str, width: int = 88) -> Column:
    """Lines of whole words, each as long as width allows; a longer word is a line of its own."""
    words = F.filter(F.split(col(c), SPACE + "+"), lambda w: w != "")

    def step(acc: Column, word: Column) -> Column:
        fits = F.length(acc["line"]) + 1 + F.length(word) <= width
        done = F.concat(acc["done"], F.array(acc["line"]))
        return F.when(acc["line"] == "", F.struct(acc["done"].alias("done"), word.alias("line"))).otherwise(
            F.struct(F.when(fits, acc["done"]).otherwise(done).alias("done"), F.when(fits, F.concat(acc["line"], F.lit(" "), word)).otherwise(word).alias("line"))
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))
    return F.aggregate(words, start, step, lambda acc: F.when(acc["line"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))))


def safe_filename(c: Column | str) -> Column:
    """The base name, stripped, at most 255 characters, or document.pdf (S3)."""
    base = stripped(F.substring_index(F.replace(col(c), F.lit("\\"), F.lit("/")), "/", -1))
    return F.left(F.coalesce(F.nullif(base, F.lit("")), F.lit("document.pdf")), F.lit(255))


def code_point_sum(c: Column | str) -> Column:
    """Sum of the code points, for stable choices of variants."""
    return F.aggregate(F.split(col(c), ""), F.lit(0).cast("long"), lambda n, ch: n + F.ascii(ch))


def expanded_query(c: Column | str) -> Column:
    """The query and the terms of every rule that it triggers, in rule order."""
    return F.concat_ws(" ", col(c), *(F.when(found(c, p), F.lit(t)) for p, t in rules.EXPANSIONS))


def intent_score(query: Column | str, passage: Column | str) -> Column:
    """0 or 1 by the first rule whose question pattern matches."""
    chain = None
    for question, evidence in rules.INTENTS:
        hit = found(passage, evidence, dotall=True).cast("int")
        chain = F.when(found(query, question), hit) if chain is None else chain.when(found(query, question), hit)
    return F.coalesce(chain.otherwise(0), F.lit(0))


def question_category(question: Column | str) -> Column:
    """The first category whose question pattern matches, or null."""
    chain = None
    for category, pattern, _ in rules.QUESTIONS:
        chain = F.when(found(question, pattern), category) if chain is None else chain.when(found(question, pattern), category)
    return chain


def category_match(category: Column | str, passage: Column | str) -> Column:
    """Whether the passage has evidence of the category, as 0 or 1 (X11)."""
    chain = None
    for name, _, pattern in rules.QUESTIONS:
        hit = found(passage, pattern).cast("int")
        chain = F.when(col(category) == name, hit) if chain is None else chain.when(col(category) == name, hit)
    return chain.otherwise(0)
