"""Line-first quality rules, in built-in functions only.

Each line is judged alone (punctuation, symbols, shouting, navigation, boilerplate); failing lines are removed; a document that
loses more than ``MAX_LOSS_PERCENT`` of its characters is rejected, and so is one that fails the base rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOSS_PERCENT = 50
#: A line fails if over this share of its characters are symbols.
MAX_SYMBOL_PERCENT = 5
#: Only lines up to this length are held against the boilerplate and navigation rules: such lines are short by nature.
SHORT_LINE = 300
#: A line of capitals fails from this length on.
SHOUT_CHARS = 20
SYMBOLS = "#*$%&|<>"
#: A line of so many words has to end like a sentence: from the first number on, as shorter ones may be headings or items of
#: lists, and below the second, as longer ones are paragraphs even where they break off.
PROSE_WORDS, PARAGRAPH_WORDS = 10, 60
#: What the last character of such a line may be.
ENDS = (".", "!", "?", "\u2026", ":", ";", "\"", ")", "]", "\u201d", "\u201c", "\u2019", "\u00bb", "\u203a")
#: In lower case; a short line that has one of them fails.  By language; those of all languages hold for every text, as pages
#: carry boilerplate of other languages than their own.
BOILERPLATE_OF = {
    "en": (
        "all rights reserved", "\u00a9", "copyright (c)", "licensed under", "terms of use", "terms of service", "privacy policy",
        "cookie policy", "use cookies", "enable javascript", "subscribe to our", "sign up for", "log in to", "click here",
        "read more", "share this", "powered by", "follow us", "back to top",
    ),
    "de": (
        "alle rechte vorbehalten", "datenschutzerkl\u00e4rung", "nutzungsbedingungen", "cookie-richtlinie", "verwendet cookies", "verwenden cookies", "javascript aktivieren",
        "newsletter abonnieren", "jetzt anmelden", "hier klicken", "klicken sie hier", "artikel teilen", "folgen sie uns", "nach oben",
    ),
    "fr": (
        "tous droits r\u00e9serv\u00e9s", "mentions l\u00e9gales", "politique de confidentialit\u00e9", "conditions d'utilisation", "conditions g\u00e9n\u00e9rales", "utilise des cookies", "utilisons des cookies",
        "activer javascript", "abonnez-vous", "inscrivez-vous", "cliquez ici", "en savoir plus", "partager cet article", "suivez-nous", "haut de page",
    ),
    "es": (
        "todos los derechos reservados", "aviso legal", "pol\u00edtica de privacidad", "pol\u00edtica de cookies", "t\u00e9rminos de uso", "condiciones de uso", "utiliza cookies", "utilizamos cookies",
        "activar javascript", "suscr\u00edbete", "reg\u00edstrate", "haga clic aqu\u00ed", "haz clic aqu\u00ed", "leer m\u00e1s", "comparte este", "s\u00edguenos", "volver arriba",
    ),
}
#: Three items or more between separators, without an end of sentence.
NAVIGATION = r"^(?:[^|\u00bb\u203a>\u2022\u00b7/]{1,30}[|\u00bb\u203a>\u2022\u00b7/]){2,}[^|\u00bb\u203a>\u2022\u00b7/]{0,30}$"
BOILERPLATE = tuple(x for phrases in BOILERPLATE_OF.values() for x in phrases)
_LIST = ", ".join("'" + x.replace("'", "\\'") + "'" for x in BOILERPLATE)
_ENDS = ", ".join(f"'{x}'" for x in ENDS)
_NAV = NAVIGATION.replace("\\", "\\\\")
_RARE_SPACES = ("\\u0009", "\\u000b", "\\u000c", "\\u000d")


def _let(value: str, var: str, body: str) -> str:
    """SQL that computes ``value`` once and uses it as ``var`` in ``body``."""
    return f"transform(array({value}), {var} -> {body})[0]"


def _words(text: str) -> str:
    """SQL for the words of a text: white space of each kind becomes a space, the text is cut at spaces."""
    spaced = f"CASE WHEN {_has(text, _RARE_SPACES)} THEN translate({text}, '{''.join(_RARE_SPACES)}', '    ') ELSE {text} END"
    return f"filter(split(replace({spaced}, '\\n', ' '), ' '), w -> w != '')"


def _has(text: str, marks: str | tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{m}')" for m in marks) + ")"


def _symbols(text: str) -> str:
    return f"(length({text}) - length(translate({text}, '{SYMBOLS}', '')))"


def _blank(line: str) -> str:
    return f"btrim({line}, ' {''.join(_RARE_SPACES)}') = ''"


# Windows of three words by hash, in the high 44 bits, and place, in the low 20 bits, of one sorted number: neighbours
# with equal hashes and equal words are repeats.  Longer texts sort pairs of hash and place.  A word counts when any
# window over it is a repeat: places p1 < p2 < ... cover 3 words each, less what they share with the place before.
_SAME = "(ws[{a}] = ws[{b}] AND ws[{a} + 1] = ws[{b} + 1] AND ws[{a} + 2] = ws[{b} + 2])"


def _places(sort: str, hash_of: str, place_of: str) -> str:
    def equal(near: str) -> str:
        other = f"s[{near}]"
        same = _SAME.format(a=place_of.format(x="e"), b=place_of.format(x=other))
        return f"({hash_of.format(x='e')} = {hash_of.format(x=other)} AND {same})"

    keep = f"filter(s, (e, j) -> (j > 0 AND {equal('greatest(j - 1, 0)')}) OR (j < size(s) - 1 AND {equal('least(j + 1, size(s) - 1)')}))"
    return _let(f"sort_array({sort})", "s", f"sort_array(transform({keep}, e -> {place_of.format(x='e')}))")


_PACKED = _places("transform(h, (x, i) -> shiftleft(x, 20) | i)", "shiftright({x}, 20)", "cast({x} & 1048575L as int)")
_PAIRED = _places("transform(h, (x, i) -> struct(x AS h, i AS i))", "{x}.h", "{x}.i")
_COVERED = "aggregate(transform(p, (x, j) -> CASE WHEN j = 0 THEN 3 ELSE least(3, x - p[greatest(j - 1, 0)]) END), 0L, (a, x) -> a + x)"
_N_REPEAT = "CASE WHEN size(ws) < 4 THEN 0L ELSE " + _let(
    "transform(sequence(0, size(ws) - 3), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2]))",
    "h",
    "CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE "
    + _let(f"CASE WHEN size(h) < 1048576 THEN {_PACKED} ELSE {_PAIRED} END", "p", _COVERED)
    + " END",
) + " END"


def _line_fails(line: str) -> str:
    """SQL that tells if a line fails a rule: punctuation, symbols (``hs``: the text has some), boilerplate, navigation, shouting."""
    unended = f"(length({line}) - length(replace({line}, ' ', '')) BETWEEN {PROSE_WORDS - 1} AND {PARAGRAPH_WORDS - 2} AND NOT substring(btrim({line}, ' {''.join(_RARE_SPACES)}'), -1) IN ({_ENDS}))"
    symbols = f"(hs AND 100 * {_symbols(line)} > {MAX_SYMBOL_PERCENT} * length({line}))"
    boiler = _let(f"lower({line})", "low", f"exists(array({_LIST}), k -> contains(low, k))")
    ended = f"substring(rtrim({line}), -1) IN ('.', '!', '?', '\u2026', '\"', ')')"
    short = f"(length({line}) <= {SHORT_LINE} AND ({boiler} OR (NOT {ended} AND {line} rlike '{_NAV}')))"
    capitals = f"length(regexp_replace({line}, '[^\\\\p{{Lu}}]+', ''))"
    small = "rlike '\\\\p{Ll}'"
    shouting = f"(length({line}) >= {SHOUT_CHARS} AND NOT substring({line}, 1, 40) {small} AND NOT {line} {small} AND 2 * {capitals} > length({line}))"
    return f"({unended} OR {symbols} OR {short} OR {shouting})"


def judge(docs: DataFrame) -> DataFrame:
    """Adds the rule counts, the cleaned text and the verdict to every document.

    Args: docs with ``text``.  Adds: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed,
    kept (boolean) and clean_text (the text without failing lines, other white space untouched).

    Defined cases: a null text has no words, is base_failed and has an empty clean_text; blank lines never fail and
    weigh nothing; repeated rows are judged alike; columns of the same names as those added are replaced.  Everything
    is one pass over each row; no rows are moved.
    """
    text = "coalesce(text, '')"
    lines = f"filter(split({text}, '\\n', -1), l -> NOT {_blank('l')})"
    counted = _let(
        _words(text),
        "ws",
        f"named_struct('n_words', cast(size(ws) as bigint), 'word_chars', cast(length(array_join(ws, '')) as bigint), 'n_repeat_words', {_N_REPEAT})",
    )
    judged = _let(
        lines,
        "ls",
        _let(
            f"filter(ls, l -> NOT {_line_fails('l')})",
            "good",
            f"""named_struct(
              'n_symbols', CASE WHEN hs THEN cast({_symbols(text)} as bigint) ELSE 0L END,
              'n_dup_lines', cast(size(ls) - size(array_distinct(ls)) as bigint),
              'n_failed', size(ls) - size(good),
              'chars', aggregate(ls, 0L, (a, l) -> a + length(l)),
              'good_chars', aggregate(good, 0L, (a, l) -> a + length(l)))""",
        ),
    )
    lined = _let(_has(text, SYMBOLS), "hs", judged)
    out = docs.select(
        *[c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")],
        F.expr(counted).alias("__w"),
        F.expr(lined).alias("__l"),
    )
    n_words, repeat = F.col("__w.n_words"), F.col("__w.n_repeat_words")
    base_failed = (n_words < MIN_WORDS) | (repeat * 100 > n_words * MAX_REPEAT_PERCENT)
    enough = F.col("__l.good_chars") * 100 >= F.col("__l.chars") * (100 - MAX_LOSS_PERCENT)
    good_lines = _let(_has(text, SYMBOLS), "hs", f"filter(split({text}, '\\n', -1), l -> {_blank('l')} OR NOT {_line_fails('l')})")
    clean = F.expr(f"CASE WHEN __l.n_failed = 0 THEN {text} ELSE array_join({good_lines}, '\\n') END")
    return out.select(
        *[c for c in out.columns if c not in ("__w", "__l")],
        n_words.alias("n_words"),
        F.col("__w.word_chars").alias("word_chars"),
        F.col("__l.n_symbols").alias("n_symbols"),
        F.col("__l.n_dup_lines").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        (~base_failed & enough).alias("kept"),
        clean.alias("clean_text"),
    )


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their failing lines removed and n_chars brought up to date (if there is one).

    Defined cases: null, empty and short texts are rejected; a null doc_id or source is kept as it is; repeated rows pass
    or fail alike; an empty table gives no rows; other columns pass through, whatever their names.
    """
    rest = [c for c in docs.columns if c != "text"]
    good = judge(docs.select(F.struct(*rest).alias("__row"), "text") if rest else docs).where("kept")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return good.select(*[(new[c] if c in new else F.col("__row")[c]).alias(c) for c in docs.columns])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
