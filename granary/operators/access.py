"""Who may see what: role sections, containment, leak checks, limits, injections, masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators import prefixes
from granary.operators.folds import folded
from granary.operators.tables import small


def visible(rows: DataFrame, asks: DataFrame, role_sections: DataFrame) -> DataFrame:
    """Pairs of an ask (``ask``, ``role``) and a row (``section``) that the role may see.

    Fails closed: a role without a line sees nothing, "*" is every section.
    """
    granted = asks.join(role_sections, "role")
    every = granted.where("section = '*'").select("ask", "role").distinct()
    some = granted.where("section <> '*'").join(every.select("ask"), "ask", "left_anti").select("ask", "role", "section").distinct()
    return rows.join(some, "section").unionByName(rows.join(small(every), how="cross"))


def contained(need: Column, allowed: Column) -> Column:
    """Whether every needed section is allowed."""
    return F.size(F.array_except(need, allowed)) == 0


# fixed values: words that try to put the rules aside, in the order in which they follow on each other.
# "?" marks a step that may be missing, "~" any ending, "..." up to thirty characters, "+" that no blank is needed before the step
INJECTION_STEPS = (
    ("игнорируй|не обращай внимания на", "?все", "?предыдущие|прошлые|свои|твои", "инструкции|правила|указания|ограничения"),
    ("забудь", "?все", "инструкции|правила|что тебе говорили"),
    ("ты больше не|теперь ты", "~"),
    ("покажи|выведи|повтори", "?свой", "системн~|исходн~", "+промпт|инструкц~|сообщение"),
    ("ignore|disregard", "?all", "previous|prior", "instructions"),
    ("system", "+prompt"),
    ("выдай", "...", "независимо от|несмотря на", "...", "доступ|прав|роль"),
    ("от имени|представь, что ты|представь что ты", "администратор|директор"),
)


def phrase_pattern(steps: tuple[str, ...]) -> str:
    """A pattern of steps with blanks between them, in any case."""
    out, gap = "(?iU)", ""
    for step in steps:
        words = "(?:" + step.lstrip("?+").replace("~", r"\w+").replace(" ", r"\s+") + ")"
        if step == "...":
            out, gap = out + gap + ".{0,30}", ""
        elif step[0] == "?":
            out, gap = out + gap + rf"(?:{words}\s+)?", ""
        else:
            out, gap = out + (r"\s*" if step[0] == "+" else gap) + words, r"\s+"
    return out


INJECTIONS = tuple(phrase_pattern(steps) for steps in INJECTION_STEPS)


def injected(text: Column) -> Column:
    """The numbers of the patterns that a text holds."""
    return F.filter(
        F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in enumerate(INJECTIONS)]), lambda x: x.isNotNull()
    )


def neutral(text: Column) -> Column:
    """A suspicious question wrapped as a quotation."""
    return F.when(F.size(injected(text)) > 0, F.concat(F.lit("Question of the user, as a quotation: «"), text, F.lit("»"))).otherwise(text)


def masked(text: Column) -> Column:
    """Secrets and personal data replaced, in a fixed order."""
    for pattern, by in (
        (r"\b[0-9]{8,10}:[A-Za-z0-9_-]{30,}", "[token]"),
        (r"(?i)(token|key|secret|password)( ?[=:] ?)[^ \n,;]+", "$1$2[hidden]"),
        (r"(\+7|8)[ -]?\(?[0-9]{3}\)?[ -]?[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{2}", "[phone]"),
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z.]+", "[e-mail]"),
        (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[ip]"),
    ):
        text = F.regexp_replace(text, pattern, by)
    return text


def permitted(requests: DataFrame, policy: DataFrame) -> DataFrame:
    """(id, allowed) of requests (id, role, method, path, kind) by a policy (role, method, prefix, exact, denied).

    A rule is for one role and method or, by "*", for any.  Of the rules of one
    role and method the longest ``prefix`` of the path decides: it allows the
    request unless it is ``exact`` and the path is longer, or the request's
    ``kind`` is among its ``denied``.  One rule that allows is enough; without any the request is refused.
    """
    key = lambda path: F.concat_ws("\n", "r", "m", path)
    rules = policy.select(F.col("role").alias("r"), F.col("method").alias("m"), "prefix", "exact", "denied").select(key("prefix").alias("prefix"), "exact", "denied")
    either = lambda c: F.explode(F.array(F.col(c), F.lit("*")))
    asked = requests.withColumn("r", either("role")).withColumn("m", either("method")).select("id", "kind", F.coalesce(key("path"), F.lit("")).alias("key"))
    found = prefixes.longest(asked, "key", rules.select("prefix")).join(rules, "prefix")
    kind = F.coalesce("kind", F.lit(""))
    yes = (~F.col("exact") | (F.col("key") == F.col("prefix"))) & ~F.coalesce(F.array_contains("denied", kind), F.lit(False))
    allowed = found.where(yes).select("id").distinct().withColumn("yes", F.lit(True))
    return requests.select("id").join(allowed, "id", "left").select("id", F.coalesce("yes", F.lit(False)).alias("allowed"))


# fixed values: what the roles of the administration may do
ADMIN_ONLY_JOBS = ("restore", "restore_drill", "backup_prune", "retention_clean", "forget_user", "migrate_vectors", "model_install")
POLICY = (
    ("admin", "*", "", False, ()), ("*", "GET", "", False, ()), ("*", "*", "/api/password", True, ()), ("operator", "*", "/api/job", False, ADMIN_ONLY_JOBS),
    ("operator", "*", "/api/backup/verify", False, ()), ("operator", "*", "/api/llm/probe", False, ()), ("operator", "*", "/api/search/test", False, ()),
    ("operator", "*", "/api/ocr/guard", False, ()), ("operator", "*", "/api/eval/", False, ()),
)


def limited(events: DataFrame, per_hour: int, per_day: int, total: int) -> DataFrame:
    """(event_id, allowed): under the user's hourly and daily and the common daily limit of events before it."""
    e = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("second", F.date_trunc("second", "ts"))
    by_user = Window.partitionBy("user_id").orderBy("us")
    hour = F.count(F.lit(1)).over(by_user.rangeBetween(-3_599_999_999, -1))
    day = F.count(F.lit(1)).over(by_user.rangeBetween(-86_399_999_999, -1))
    # of the day: whole seconds before, at most 86,400 rows, and what came earlier in the second
    before = Window.partitionBy(F.to_date("second")).orderBy("second").rowsBetween(Window.unboundedPreceding, -1)
    seconds = e.groupBy("second").agg(F.count(F.lit(1)).alias("n")).select("second", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = F.count(F.lit(1)).over(Window.partitionBy("second").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    counted = e.select("event_id", "second", (hour < per_hour).alias("h"), (day < per_day).alias("d"), within.alias("within")).join(seconds, "second")
    return counted.select("event_id", (F.col("h") & F.col("d") & (F.col("earlier") + F.col("within") < total)).alias("allowed"))


def locked(attempts: DataFrame, keys: list[str], n: int, seconds: int, since: int | None = None) -> DataFrame:
    """(event_id, locked) of attempts (event_id, ts, failed, and ``keys``: account, address): whether any key is locked at the attempt.

    A key is locked while ``n`` failures lie in the window before, of those since its last success, or behind ``since`` (microseconds) without one.
    A null key or time locks nothing.  A failure stands once more where it leaves the window, so all counts run from
    the beginning of a key's history and no attempt looks at its window row by row.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    enters = F.struct(us.alias("us"), F.lit(False).alias("leaves"))
    leaves = F.struct((us + seconds * 1_000_000).alias("us"), F.lit(True).alias("leaves"))
    rows = attempts.select("*", F.explode(F.when(F.col("failed") & us.isNotNull(), F.array(enters, leaves)).otherwise(F.array(enters))).alias("__at")).select(
        "event_id", *keys, F.col("__at.us").alias("us"), F.col("__at.leaves").alias("__leaves"),
        (F.col("failed") & ~F.col("__at.leaves")).alias("__failure"), (~F.col("failed") & ~F.col("__at.leaves")).alias("__success"),
    )
    known, any_key = F.col("us").isNotNull(), F.lit(False)
    early = F.lit(False) if since is None else F.col("us") <= since
    for key in keys:
        history = Window.partitionBy(key).orderBy("us")
        before, upto = history.rangeBetween(Window.unboundedPreceding, -1), history.rangeBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({
            "__so_far": F.count_if(F.col("__failure") & known).over(before), "__left": F.count_if("__leaves").over(upto),
            "__upto": F.count_if(F.col("__failure") & known).over(upto), "__early": F.count_if(F.col("__failure") & early).over(before),
        })
        at_success = F.coalesce(F.max(F.when(F.col("__success") & known, F.col("__upto"))).over(before), F.col("__early"))
        # all are beginnings of the key's history: the longest that does not count takes the others in
        counted = F.col("__so_far") - F.greatest("__left", at_success)
        rows = rows.withColumn(f"__by_{key}", F.col(key).isNotNull() & known & (counted >= n)).drop("__so_far", "__left", "__upto", "__early")
        any_key = any_key | F.col(f"__by_{key}")
    return rows.where("NOT __leaves").select("event_id", any_key.alias("locked"))


class Calls:
    """The calls of one number that were let through in the last hour."""

    def __init__(self, most: int) -> None:
        self.most, self.times = most, []

    def take(self, us: int, id: int) -> list[tuple]:  # noqa: A002
        self.times = [x for x in self.times if us - x < 3_600_000_000]
        ok = len(self.times) < self.most
        if ok:
            self.times.append(us)
        return [(id, ok)]

    def close(self) -> list[tuple]:
        return []


def capped_calls(calls: DataFrame, most: int) -> DataFrame:
    """(number, id, allowed) of calls (number, us, id): at most ``most`` of a number are let through in an hour; refused ones do not count."""
    return folded(calls, "number", [F.col("us"), F.col("id")], ["us", "id"], lambda: Calls(most), "id long, allowed boolean")


def phone(number: Column) -> Column:
    """Digits of a caller's number: 8 becomes 7; only 11 digits count."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    seven = F.when(digits.startswith("8"), F.concat(F.lit("7"), F.substring(digits, 2, 20))).otherwise(digits)
    return F.when(F.length(seven) == 11, seven)
