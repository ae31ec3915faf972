"""Audits of a text against its source: refusals, languages, structure, integrity.

Pairs come as (unit, source, target); each audit is a column over one row, or explodes the
lines of a pair and works on (unit, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.markers import numbers

#: Kinds of refusals, in order, and how they read.
REFUSALS = (
    ("English refusal", r"(?i)\b(?:i|we)\s+(?:cannot|can't|can not|won't|will not|must not|mustn't)\s+(?:translate|assist|help|provide|comply|process|continue|generate|rewrite|fulfill)\b"),
    ("English refusal", r"(?i)\b(?:i am|i'm)\s+unable\s+to\s+(?:translate|assist|help|provide|comply|process|continue|generate|rewrite)\b"),
    ("English refusal", r"(?i)\b(?:i\s+must|i\s+have\s+to)\s+refuse\b"),
    ("English refusal", r"(?i)\b(?:i|we)\s+(?:refuse|decline)\s+to\s+(?:translate|assist|help|provide|process|continue|generate|rewrite)\b"),
    ("English policy disclaimer", r"(?i)\b(?:as\s+an?\s+ai|as\s+a\s+language\s+model)\b|\b(?:cannot|can't|unable|refuse).{0,50}\b(?:safety|content)\s+(?:policy|policies|guidelines?)\b"),
    ("Chinese refusal", r"(?:抱歉|很抱歉).{0,25}(?:无法|不能|不可以|拒绝).{0,20}(?:翻译|协助|帮助|处理|提供|改写|重写|生成|回答|完成(?:这(?:项|个)|该)?(?:请求|任务))"),
    ("Chinese refusal", r"(?<![\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}])(?:我|本人)(?:无法|不能|不可以|拒绝).{0,20}(?:翻译|协助|帮助|处理|提供|改写|重写|生成|回答|完成(?:这(?:项|个)|该)?(?:请求|任务))"),
    ("Chinese policy disclaimer", r"作为(?:一个)?(?:AI|人工智能|语言模型)(?:[，,]\s*(?:我|本人)\s*(?:无法|不能|不可以|拒绝)|[，,]?\s*(?:无法|不能|不可以|拒绝)\s*(?:翻译|协助|帮助|处理|提供|改写|重写|生成|回答|完成)|[，,]\s*(?:会|旨在)\s*(?:遵循|确保|保护|提供|协助))|(?:无法|不能|不可以|拒绝|抱歉).{0,30}(?:安全|内容|使用)政策"),
    ("Chinese translation placeholder", r"(?:这是|以下是|以下为|这里是)(?:一份|本次|对原文的|对该段(?:文字|内容)?的|纯正(?:的)?学术)?(?:中文)?(?:翻译结果|翻译内容|翻译文本)(?:。|！|!|：|:|$)"),
)


def straight(c: Column) -> Column:
    """Curly quotes as straight ones."""
    return F.translate(c, "‘’“”", "''\"\"")


def refusal_patterns(line: Column) -> Column:
    """Numbers of the REFUSALS that a line shows."""
    return F.array_compact(F.array(*[F.when(straight(line).rlike(p), F.lit(i)) for i, (_, p) in enumerate(REFUSALS)]))


def refusals(pairs: DataFrame, near: int = 30) -> DataFrame:
    """First line (counted among lines with text) of each target that reads like a refusal and
    has no counterpart: not its source line, not a source line with the same pattern, not any within
    ``near`` lines. (unit, line_no, kind)."""
    def shown(c: str) -> DataFrame:
        ls = F.filter(T.lines(F.col(c)), lambda x: F.trim(x) != "")
        rows = pairs.select("unit", F.posexplode(ls).alias("pos", "line")).withColumn("patterns", refusal_patterns(F.col("line")))
        return rows.where(F.size("patterns") > 0).select("unit", "pos", "patterns")

    target = shown("target").withColumn("pattern", F.col("patterns")[0])
    source = shown("source").groupBy("unit").agg(F.collect_list("pos").alias("at"), F.array_distinct(F.flatten(F.collect_list("patterns"))).alias("kinds"))
    both = target.join(source, "unit", "left")
    excused = F.array_contains("kinds", F.col("pattern")) | F.exists("at", lambda p: F.abs(p - F.col("pos")) <= near)
    both = both.where(~F.coalesce(excused, F.lit(False)))
    labels = F.array(*[F.lit(k) for k, _ in REFUSALS])
    first = both.groupBy("unit").agg(F.min(F.struct("pos", "pattern")).alias("hit"))
    return first.select("unit", (F.col("hit.pos") + 1).alias("line_no"), F.element_at(labels, F.col("hit.pattern") + 1).alias("kind"))


def letter_ratio(text: Column) -> Column:
    """(cjk, latin, letters) of the prose of a text."""
    t = T.language_audit_text(text)
    cjk, latin = T.cjk_letters(t), T.latin_letters(t)
    return F.struct(cjk.alias("cjk"), latin.alias("latin"), (cjk + latin).alias("letters"))


def language_density(source: Column, target: Column, threshold: float = 0.60, least_source: int = 120, least_target: int = 80) -> Column:
    """For Chinese targets: (ratio, blocked); the ratio is null where there is too little text."""
    s, t = letter_ratio(source), letter_ratio(target)
    ratio = F.when((s["latin"] >= least_source) & (t["letters"] >= least_target), t["cjk"] / t["letters"])
    return F.struct(F.bround(ratio, 4).alias("ratio"), F.coalesce(ratio < threshold, F.lit(False)).alias("blocked"))


def unchanged_run(source: Column, target: Column, least_chars: int = 80, least_letters: int = 60) -> Column:
    """(start, end) of the first run of long lines that are equal in both texts, if it has
    2 lines or more; else null."""
    flags = F.zip_with(T.lines(source), T.lines(target), lambda a, b: F.coalesce((F.trim(a) == F.trim(b)) & (F.char_length(F.trim(a)) >= least_chars) & (F.regexp_count(F.trim(a), F.lit("[A-Za-z]")) >= least_letters), F.lit(False)))
    start = F.array_position(flags, True)
    rest = F.slice(flags, F.greatest(start, F.lit(1)).cast("int"), F.greatest(F.size(flags), F.lit(1)))
    stop = F.array_position(rest, False)
    n = F.when(stop > 0, stop - 1).otherwise(F.size(rest))
    return F.when((start > 0) & (n >= 2), F.struct(start.cast("int").alias("start"), (start + n - 1).cast("int").alias("end")))


def diff_summary(source: Column, target: Column) -> Column:
    """Lines, headings and code fences of both texts, and whether they changed."""
    def count(c: Column) -> tuple[Column, Column, Column]:
        return F.size(T.lines(c)), F.regexp_count(c, F.lit(r"(?m)^#{1,6}\s")), F.regexp_count(c, F.lit("```"))

    a, b = count(source), count(target)
    names = ("lines", "headings", "fences")
    return F.struct(*[x.alias(f"source_{n}") for n, x in zip(names, a, strict=True)], *[x.alias(f"target_{n}") for n, x in zip(names, b, strict=True)], *[(x != y).alias(f"{n}_changed") for n, x, y in zip(names, a, b, strict=True)])


def prose_blocks(text: Column) -> Column:
    """Blocks of prose of 24 characters or 8 words. Lines are judged first: headings, rules and blank lines end a block; words
    that a hyphen breaks over two lines are joined; images, tags and note marks count as spaces."""
    def ends_block(x: Column) -> Column:
        bare = F.trim(x)
        return (bare == "") | bare.rlike(r"^#{1,6}\s") | F.translate(bare, " ", "").rlike(r"^[-*_]{3,}$")

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.when(ends_block(x), F.lit("\x00")).otherwise(F.trim(x)))
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"(?<=\p{L})\p{Pd}\n(?=\p{L})", "")
    blocks = F.transform(F.split(joined, r"\x00"), lambda b: T.collapsed(F.regexp_replace(b, r"(?i)!\[[^\]]*\]\([^)]*\)|<sup>\s*\d+\s*</sup>|\[\^\s*\d+\s*\]:?|<[^>]+>", " ")))
    return F.filter(blocks, lambda b: (F.char_length(b) >= 24) | (F.regexp_count(b, F.lit(f"[{T.WORD_CHARS}]+")) >= 8))


def duplicated_blocks(pairs: DataFrame) -> DataFrame:
    """Blocks that the target has more than once and more often than the source: unit, block, n_source, n_target."""
    rows = pairs.select("unit", F.explode(prose_blocks(F.col("source"))).alias("block"), F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(
        pairs.select("unit", F.explode(prose_blocks(F.col("target"))).alias("block"), F.lit(0).alias("s"), F.lit(1).alias("t"))
    )
    n = rows.groupBy("unit", "block").agg(F.sum("s").alias("n_source"), F.sum("t").alias("n_target"))
    return n.where("n_target > 1 and n_target > n_source")


def missing_numbers(source: Column, target: Column) -> Column:
    """Numbers of the source that are not a subsequence of the target's: greedy, in order."""
    start = F.struct(numbers(target).alias("rest"), F.array().cast("array<string>").alias("missing"))

    def step(acc: Column, n: Column) -> Column:
        at = F.array_position(acc["rest"], n)
        found = F.struct(F.slice(acc["rest"], (at + 1).cast("int"), F.size(acc["rest"])).alias("rest"), acc["missing"].alias("missing"))
        # a number that is not there uses up what is left, as a search through to the end does
        lost = F.struct(F.array().cast("array<string>").alias("rest"), F.concat(acc["missing"], F.array(n)).alias("missing"))
        return F.when(at > 0, found).otherwise(lost)

    return F.aggregate(numbers(source), start, step, lambda acc: acc["missing"])


def note_marks(text: Column) -> Column:
    """Keys of note references and definitions in order, outside code and comments."""
    t = T.replaced(F.coalesce(text, F.lit("")), (r"(?s)```.*?(?:```|\z)", " "), (r"(?s)<!--.*?-->", " "), (r"`[^`\n]*`", " "))
    return F.regexp_extract_all(t, F.lit(r"\[\^([A-Za-z0-9_-]+)\]"), F.lit(1))


def note_mark_errors(source: Column, target: Column) -> Column:
    """What differs in the note marks of two texts."""
    sup = lambda c: F.regexp_extract_all(c, F.lit(r"(?i)<sup>\s*([^<]*?)\s*</sup>"), F.lit(1))
    alternate = target.rlike(r"(?:\[\^[^\]]*$)|(?:［\^)|(?:\[＾)") & ~source.rlike(r"(?:\[\^[^\]]*$)|(?:［\^)|(?:\[＾)")
    return F.array_compact(F.array(F.when(note_marks(source) != note_marks(target), "marks differ"), F.when(sup(source) != sup(target), "superscripts differ"), F.when(alternate, "other notation")))


def syntax_issues(text: Column) -> Column:
    """Unclosed fences, and outside fences lines with an odd number of backtick runs or of unescaped
    dollar signs (one that reads like a price is let pass)."""
    ls = T.lines(text)
    fence = lambda x: x.rlike(r"^\s{0,3}```")
    marked = F.transform(ls, lambda x, i: F.struct(x.alias("line"), (i + 1).alias("no"), F.size(F.filter(F.slice(ls, F.lit(1), i + 1), fence)).alias("fences")))
    plain = F.filter(marked, lambda m: (m["fences"] % 2 == 0) & ~fence(m["line"]))
    ticks = F.transform(F.filter(plain, lambda m: F.regexp_count(m["line"], F.lit("`+")) % 2 == 1), lambda m: F.concat(F.lit("backticks "), m["no"].cast("string")))
    unescaped = lambda m: F.regexp_count(F.regexp_replace(m["line"], r"\\\\\$|`[^`]*`", ""), F.lit(r"\$"))
    dollars = F.transform(F.filter(plain, lambda m: (unescaped(m) % 2 == 1) & ~((unescaped(m) == 1) & m["line"].rlike(r"\$[0-9]"))), lambda m: F.concat(F.lit("dollars "), m["no"].cast("string")))
    open_ = F.when(F.size(F.filter(ls, fence)) % 2 == 1, F.array(F.lit("unclosed fence"))).otherwise(F.array().cast("array<string>"))
    return F.concat(open_, ticks, dollars)


#: Structure that has to survive: name and pattern.
STRUCTURE = (
    ("headings", r"(?m)^(#{1,6})\s"), ("images", r"(!\[[^\]]*\]\([^)]*\))"), ("links", r"(?<!!)(\[[^\]^][^\]]*\]\([^)]*\))"), ("tables", r"(?m)^(\s*\|.*\|\s*)$"),
    ("rules", r"(?m)^(\s{0,3}(?:[-*_]\s*){3,})$"), ("fences", r"(?m)^(\s{0,3}```)"),
)


def structure_errors(source: Column, target: Column) -> Column:
    """Kinds of structure that are not as many in both texts, and ``levels`` if headings' levels differ."""
    found = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    differ = [F.when(F.size(found(source, p)) != F.size(found(target, p)), n) for n, p in STRUCTURE]
    levels = F.when((F.size(found(source, STRUCTURE[0][1])) == F.size(found(target, STRUCTURE[0][1]))) & (found(source, STRUCTURE[0][1]) != found(target, STRUCTURE[0][1])), "levels")
    return F.array_compact(F.array(*differ, levels))


def fragmentation(text: Column, blocks: int = 8, single: float = 0.6, short: float = 0.6) -> Column:
    """Whether prose falls into many short blocks of one line: (n_blocks, fragmented)."""
    bs = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n[ \t]*\n"), lambda b: (F.trim(b) != "") & ~b.rlike(r"^\s*(?:#{1,6}\s|[-*+]\s|>|\||```)"))
    one = F.size(F.filter(bs, lambda b: F.size(F.filter(T.lines(b), lambda x: F.trim(x) != "")) == 1))
    small = F.size(F.filter(bs, lambda b: (F.char_length(F.trim(b)) <= 90) | (F.regexp_count(b, F.lit(r"\S+")) <= 14)))
    n = F.size(bs)
    return F.struct(n.alias("n_blocks"), ((n >= blocks) & (one >= single * n) & (small >= short * n)).alias("fragmented"))


def integrity(pairs: DataFrame, removed: Column | None = None) -> DataFrame:
    """(unit, n_source_tokens, missing numbers, duplicated blocks, valid) of each pair; ``removed``: tokens lost, if known."""
    tokens = lambda c: F.regexp_count(c, F.lit(f"[{T.WORD_CHARS}]+"))
    lost = F.greatest(F.lit(0), tokens(F.col("source")) - tokens(F.col("target"))) if removed is None else removed
    out = pairs.select("unit", tokens(F.col("source")).alias("n_source_tokens"), lost.alias("n_lost"), missing_numbers(F.col("source"), F.col("target")).alias("missing"))
    dup = duplicated_blocks(pairs).groupBy("unit").agg(F.count(F.lit(1)).alias("n_duplicated"))
    out = out.join(dup, "unit", "left").fillna(0, ["n_duplicated"])
    most = F.greatest(F.lit(8), F.ceil(F.col("n_source_tokens") * 0.02))
    return out.withColumn("valid", (F.col("n_lost") < most) & (F.size("missing") == 0) & (F.col("n_duplicated") == 0))


def lost_labels(labels: DataFrame, lines: DataFrame) -> DataFrame:
    """Protected labels (unit, label) that no line (unit, line) of the unit shows any more."""
    keyed = lines.select("unit", T.match_title_key(F.col("line")).alias("key")).where("key != ''")
    return labels.withColumn("key", T.match_title_key(F.col("label"))).join(keyed, ["unit", "key"], "left_anti").drop("key")


def fence_leaks(prompts: DataFrame, foreign: DataFrame, least: int = 3) -> DataFrame:
    """Foreign snippets (unit, snippet) that stand outside the fences of a prompt (unit, prompt)."""
    snippets = foreign.select("unit", T.collapsed(F.col("snippet")).alias("snippet")).where(F.char_length("snippet") >= least).distinct()
    outside = prompts.select("unit", T.outside_fences(F.col("prompt")).alias("outside"))
    return snippets.join(outside, "unit").where(F.contains("outside", F.col("snippet"))).select("unit", "snippet")


def aligned_pairs(source: DataFrame, target: DataFrame, on: str = "unit") -> DataFrame:
    """Every source with its target, null where there is none: (unit, source, target, missing)."""
    both = source.select(on, F.col("text").alias("source")).join(target.select(on, F.col("text").alias("target"), F.lit(False).alias("m")), on, "left")
    return both.select(on, "source", "target", F.coalesce("m", F.lit(True)).alias("missing"))


def note_signatures(text: Column) -> Column:
    """Definitions of notes by key: array of (key, words in order)."""
    t = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?m)^\s{0,3}\[\^([A-Za-z0-9_-]+)\]:[ \t]*(.*)$"), F.lit(0))
    return F.transform(t, lambda d: F.struct(F.regexp_extract(d, r"\[\^([A-Za-z0-9_-]+)\]", 1).alias("key"), F.lower(F.regexp_replace(F.regexp_replace(d, r"^.*?\]:", ""), f"[^{T.WORD_CHARS}]", "")).alias("signature")))


def ordinal_in(df: DataFrame, part: list[str], order: str, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(order)))
