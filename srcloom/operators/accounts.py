"""Account declarations of entry input structs: attributes, validations, types.

Input: account rows with struct_id, ord, account_name, wrapper, struct_name and
the raw attribute text attr. The long form account_attr has one row for each
attribute item: struct_id, ord, pos, key, value, error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom.functions.text import at_sign, let, spaced, split_top_level, stripped

KEY = ["struct_id", "ord"]
# Flags without a value, and items that only validate.
FLAGS = ["mut", "init", "init_if_necessary", "zero", "bump", "rent_exempt"]
VALIDATION_WORDS = ["has_one", "constraint", "zero", "owner", "token::mint", "token::authority", "associated_token::mint", "associated_token::authority", "address"]
NAMED_KEYS = ["seeds", "bump", "close", "payer", "space", "owner", "constraint", "realloc", "has_one", "address", "token::mint", "token::authority", "associated_token::mint", "associated_token::authority", "associated_token::token_program", "realloc::payer", "realloc::zero", "rent_exempt"]
#: The first = that is part of no comparison.
_ASSIGN = r"^((?:[^=!<>]|[!<>]=|==|[!<>](?!=))*?)(?<![=!<>])=(?!=)(.*)$"

# What ends a line for a pattern.
LINE_ENDS = ["\n", "\r", "\u0085", "\u2028", "\u2029"]


def attribute_items(df: DataFrame, col: str = "attr") -> DataFrame:
    """df with items, the attribute split at top-level commas."""
    return df.withColumn("items", split_top_level(F.coalesce(col, F.lit(""))))


def account_attrs(df: DataFrame) -> DataFrame:
    """One row for each attribute item. Flags have no value; an unknown `key = value` is a constraint of that text."""
    # items are read inside the array, where nothing is read again for a filter
    rows = attribute_items(df).select(*KEY, F.posexplode(F.transform("items", _parsed)).alias("pos", "x"))
    return rows.where("x.key is not null").select(*KEY, "pos", "x.key", "x.value", "x.error")


def _parsed(item: Column) -> Column:
    """(key, value, error) of an item; the key is null if it is neither a flag nor an assignment."""
    head = F.substring_index(item, "=", 1)
    # most items are one line whose first = is that one: these need no pattern
    plain = F.contains(item, F.lit("=")) & ~F.right(head, F.lit(1)).isin("!", "<", ">") & (F.substring(item, F.length(head) + 2, F.lit(1)) != "=")
    for end in LINE_ENDS:
        plain = plain & ~F.contains(item, F.lit(end))
    k = F.when(plain, head).when(F.contains(item, F.lit("=")), F.regexp_extract(item, _ASSIGN, 1)).otherwise("")
    v = F.when(plain, F.substring(item, F.length(head) + 2, F.length(item))).when(F.contains(item, F.lit("=")), F.regexp_extract(item, _ASSIGN, 2)).otherwise("")
    return let(F.struct(F.replace(F.trim(k), F.lit(" "), F.lit("")).alias("k"), F.trim(v).alias("v"), item.alias("item")), _facts)


def _facts(x: Column) -> Column:
    is_kv, known, with_error = (x["k"] != "") & (x["v"] != ""), x["k"].isin(NAMED_KEYS), x["k"].isin("has_one", "address")
    expression, error = at_sign(x["v"])
    value = F.when(with_error, expression).when(known, x["v"]).otherwise(F.concat(x["k"], F.lit(" = "), x["v"]))
    return F.struct(
        F.when(is_kv, F.when(known, x["k"]).otherwise("constraint")).when(x["item"].isin(FLAGS), x["item"]).alias("key"),
        F.when(is_kv, value).alias("value"),
        F.when(is_kv & with_error, error).alias("error"),
    )


def _first(key: str) -> Column:
    return F.min(F.when(F.col("key") == key, F.struct("pos", "value")))["value"]


def _last(key: str) -> Column:
    return F.max(F.when(F.col("key") == key, F.struct("pos", "value")))["value"]


def _has(*keys: str) -> Column:
    return F.coalesce(F.bool_or(F.col("key").isin(*keys)), F.lit(False))


def account_flags(account_attr: DataFrame) -> DataFrame:
    """The long form pivoted: flags and single values of each account."""
    seeds = _last("seeds")
    return account_attr.groupBy(*KEY).agg(
        _has("mut").alias("is_mut"),
        _has("init", "init_if_necessary").alias("is_init"),
        _has("close").alias("is_close"),
        F.coalesce(F.bool_or((F.col("key") == "zero") | ((F.col("key") == "realloc::zero") & (F.col("value") == "true"))), F.lit(False)).alias("zero"),
        F.coalesce(F.bool_or((F.col("key") == "rent_exempt") & (F.col("value").isNull() | (F.col("value") == "enforce"))), F.lit(False)).alias("rent_exempt"),
        F.coalesce(split_seeds(seeds), F.array().cast("array<string>")).alias("seeds"),
        F.coalesce(_last("bump"), F.when(_has("bump"), "")).alias("bump"),
        F.coalesce(_last("payer"), _last("realloc::payer"), _last("close"), F.lit("")).alias("rent_account"),
        _last("owner").alias("owner"),
        _last("space").alias("space"),
        _last("realloc").alias("realloc"),
        F.coalesce(_last("token::mint"), _last("associated_token::mint")).alias("token_mint"),
    ).withColumn("is_pda", F.size("seeds") > 0)


def split_seeds(value: Column) -> Column:
    return split_top_level(F.regexp_replace(F.trim(value), r"^\[(.*)\]$", "$1"))


def account_attrs_regex(df: DataFrame) -> DataFrame:
    """The same facts by patterns over the raw text."""
    attr = F.coalesce("attr", F.lit(""))
    seeds = F.regexp_extract(attr, r"seeds\s*=\s*\[((?:[^\[\]]|\[[^\]]*\])*)\]", 1)
    payer, close = F.regexp_extract(attr, r"\bpayer\s*=\s*(\w+)", 1), F.regexp_extract(attr, r"\bclose\s*=\s*(\w+)", 1)
    checks = F.regexp_extract_all(attr, F.lit(r"(?:^|,)\s*((?:has_one|constraint|address)\s*=\s*[^,]*)"), F.lit(1))
    return df.select(
        *KEY,
        attr.rlike(r"(^|[,\s])mut\s*(,|$)").alias("is_mut"),
        attr.rlike(r"(^|[,\s])init(_if_necessary)?\s*(,|$)").alias("is_init"),
        attr.rlike(r"\bclose\s*=").alias("is_close"),
        F.when(payer != "", payer).otherwise(close).alias("rent_account"),
        split_top_level(seeds).alias("seeds"),
        F.transform(checks, lambda c: F.trim(c)).alias("validations"),
    )


# The order in which validations are listed, and how each is written.
VALIDATION_ORDER = ["has_one", "address", "token::authority", "associated_token::mint", "associated_token::authority", "associated_token::token_program", "zero", "owner", "token::mint", "constraint"]


def account_validations(account_attr: DataFrame) -> DataFrame:
    """Validation texts of each account in order, its rent account and token mint."""
    rank = F.create_map(*[F.lit(x) for k, w in enumerate(VALIDATION_ORDER) for x in (w, k)])[F.col("key")]
    text = F.when(F.col("key") == "zero", "zero").otherwise(F.concat("key", F.lit(" = "), "value", F.coalesce(F.concat(F.lit(" @ "), "error"), F.lit(""))))
    listed = F.transform(F.array_sort(F.collect_list(F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("pos"), text.alias("t"))))), lambda s: s["t"])
    return account_attr.groupBy(*KEY).agg(listed.alias("validations"), F.coalesce(_last("payer"), _last("close"), F.lit("")).alias("rent_account"), F.coalesce(_last("token::mint"), _last("associated_token::mint")).alias("token_mint"))


def account_type(account: DataFrame, symbol: DataFrame) -> DataFrame:
    """account with account_type; symbol names the known account structs (sub_type SolanaAccount)."""
    known = symbol.where("sub_type = 'SolanaAccount'").select(F.col("name").alias("k_name")).distinct()
    kind = (
        F.when(F.col("wrapper") == "Signer", "Signer")
        .when(F.col("wrapper").isin("UncheckedAccount", "AccountInfo"), "UncheckedAccount")
        .when(F.col("wrapper") == "SystemAccount", "SystemAccount")
        .when(F.col("struct_name") == "TokenAccount", "TokenAccount")
        .when(F.col("struct_name") == "Mint", "Mint")
        .when(F.col("k_name").isNotNull(), "ProgramStateAccount")
        .otherwise("Other")
    )
    return account.join(known, F.col("struct_name") == F.col("k_name"), "left").withColumn("account_type", kind).drop("k_name")


def accounts_without_validation(df: DataFrame, words=None) -> DataFrame:
    """The attribute items of each account that hold none of the validation words, in order."""
    drop = list(words or VALIDATION_WORDS)
    kept = attribute_items(df).withColumn("items", F.filter("items", lambda i: ~F.exists(F.array(*[F.lit(w) for w in drop]), lambda w: F.contains(i, w))))
    return kept.select(*KEY, "items")


# What a check's name means, the first rule that matches counting. Patterns are over the lower-case name.
CHECK_RULES = [
    ("Signer", "signer"),
    ("Writable", "writable"),
    ("SystemProgram", "system"),
    ("TokenProgram", "tokenprograminterface|token_program_interface"),
    ("TokenProgram", "^(?!.*tokenaccount).*tokenprogram"),
    ("Mint", "mintinterface|mint_interface"),
    ("Mint", "^(?!.*token).*mint"),
    ("TokenAccount", "tokenaccountinterface|token_account_interface|tokenaccount"),
    ("ProgramOwned", "programaccount|program_account|^owned_by$"),
]


def inferred_checks(source_file: DataFrame, rules=None) -> DataFrame:
    """struct_name, field, check_name, semantic of the checks in `impl TryFrom<..> for T` bodies, each repeated as often as it stands there."""
    text = F.regexp_replace(F.regexp_replace("content", r"//[^\n]*", ""), r"\s+", " ")
    impls = source_file.select("path", F.explode(F.regexp_extract_all(text, F.lit(r"impl(?:<[^>]*>)? TryFrom ?<.*?> for \w+.*?(?= impl[ <]|$)"), F.lit(0))).alias("body"))
    statements = impls.select("path", F.regexp_extract("body", r"> for (\w+)", 1).alias("struct_name"), F.posexplode(F.split("body", ";")).alias("n", "s"))
    s = spaced(F.col("s"))
    flat = statements.withColumn("s", s)
    static = r"([A-Z]\w*)(?:<[^>]*>)?::(\w+)\(\s*([a-z_]\w*)\s*[,)]"
    one = flat.select("path", "struct_name", "n", F.lit(1).alias("form"), F.lit(0).alias("k"), F.concat_ws("::", F.regexp_extract("s", static, 1), F.regexp_extract("s", static, 2)).alias("check_name"), F.regexp_extract("s", static, 3).alias("field")).where("field <> ''")
    batch = r"([A-Z]\w*)(?:<[^>]*>)?::(\w+)\([^&]*&\s*\[([^\]]*)\]"
    many = flat.select("path", "struct_name", "n", F.lit(2).alias("form"), F.posexplode(F.transform(F.split(F.regexp_extract("s", batch, 3), ","), lambda f: F.trim(f))).alias("k", "field"), F.concat_ws("::", F.regexp_extract("s", batch, 1), F.regexp_extract("s", batch, 2)).alias("check_name")).where("field rlike '^\\\\w+$'")
    inline = r"(\w+)\.(is_signer|is_writable|owned_by)\("
    method = flat.select("path", "struct_name", "n", F.lit(3).alias("form"), F.lit(0).alias("k"), F.regexp_extract("s", inline, 2).alias("check_name"), F.regexp_extract("s", inline, 1).alias("field")).where("field <> ''")
    every = one.unionByName(many).unionByName(method)
    low = F.lower("check_name")
    semantic = F.coalesce(*[F.when(low.rlike(p), m) for m, p in (rules or CHECK_RULES)], F.lit("Unknown"))
    return every.select("path", "struct_name", "field", "check_name", semantic.alias("semantic"), "n", "form", "k")


def checked_accounts(fields: DataFrame, checks: DataFrame) -> DataFrame:
    """What the checks say of each field (columns struct_name, field): wrapper, type, mut and the check names in order.

    Of several kinds the last check decides, except that program ownership
    only counts when nothing was known before it.
    """
    order = F.struct("n", "form", "k")
    kind = F.when(~F.col("semantic").isin("Unknown", "Writable", "ProgramOwned"), F.struct(order.alias("o"), F.col("semantic")))
    told = checks.groupBy("struct_name", "field").agg(
        F.max(kind)["semantic"].alias("last_kind"),
        F.min(kind)["o"].alias("first_kind"),
        F.min(F.when(F.col("semantic") == "ProgramOwned", order)).alias("owned"),
        F.bool_or(F.col("semantic") == "Writable").alias("is_mut"),
        F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("check_name")))), lambda s: s["check_name"]).alias("validations"),
    )
    wrapper = {"Signer": ("Signer", "Signer"), "SystemProgram": ("SystemAccount", "SystemAccount"), "TokenProgram": ("Program", "TokenProgram"), "Mint": ("Mint", "Mint"), "TokenAccount": ("TokenAccount", "TokenAccount")}
    pick = lambda at: F.coalesce(F.create_map(*[F.lit(x) for k, v in wrapper.items() for x in (k, v[at])])[F.col("last_kind")], F.when(F.col("owned").isNotNull(), ("Account", "ProgramAccount")[at]), F.lit("AccountView"))
    out = fields.join(told, ["struct_name", "field"], "left")
    return out.select("struct_name", "field", pick(0).alias("wrapper"), pick(1).alias("account_struct"), F.coalesce("is_mut", F.lit(False)).alias("is_mut"), F.coalesce("validations", F.array().cast("array<string>")).alias("validations"))


def signer_comments(source_line: DataFrame, account: DataFrame) -> DataFrame:
    """Comments above each signer field, joined with '. ': struct_id, account_name, description.

    account has struct_id, account_name, path, line_no (of the field). A comment
    belongs to the next `pub` line of its file.
    """
    ahead = Window.partitionBy("path").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, 0)
    marked = source_line.withColumn("of", F.last(F.when(stripped(F.col("line")).rlike(r"^pub\b"), F.col("line_no")), ignorenulls=True).over(ahead))
    text = F.trim(F.regexp_replace(stripped(F.col("line")), r"^/{2,}!?", ""))
    comments = marked.where(stripped(F.col("line")).rlike("^//")).groupBy("path", F.col("of").alias("line_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))), lambda s: s["t"]), ". ").alias("description"))
    return account.join(comments, ["path", "line_no"], "left").select("struct_id", "account_name", F.coalesce("description", F.lit("")).alias("description"))
