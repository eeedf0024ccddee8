"""Conversations: prompt injection, cache keys, chunks that keep placeholders whole, intent around an entity."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrimlake.functions import text as T

# fixed values: what marks an entity as asked about, and as used in a statement
ASKED = (r"(是哪|是誰|是谁|叫什么|叫啥|what is|who is)", r"(介绍|描述|explain|describe|introduce|tell me about)")
STATED = (r"(联系|呼叫|发邮件|发送|写信|给|告诉|通知|提醒|call|email|text|send|write|notify)", r"(的电话|的邮箱|的地址|的身份证|的手机|'s phone|'s email|'s address)")
AROUND = 50


def inject_prompt(turns: DataFrame, sessions: DataFrame, session_col: str, order_col: str, prompt: str, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns with a prompt added in each of the sessions: to the end of its first system turn, or as a new first turn."""
    asked = sessions.select(session_col).distinct()
    first = turns.where(F.col(role_col) == "system").groupBy(session_col).agg(F.min(order_col).alias("_first")).join(asked, session_col)
    here = F.coalesce(F.col(order_col) == F.col("_first"), F.lit(False)) & (F.col(role_col) == "system")
    added = turns.join(first, session_col, "left").withColumn(text_col, F.when(here, F.concat(text_col, F.lit("\n\n" + prompt))).otherwise(F.col(text_col))).drop("_first")
    new = asked.join(first, session_col, "left_anti").select(session_col, F.lit(-1).cast("long").alias(order_col), F.lit("system").alias(role_col), F.lit(prompt).alias(text_col))
    return added.select(session_col, order_col, role_col, text_col).unionByName(new)


def cache_keys(turns: DataFrame, session_col: str, order_col: str, tenant: Column, model: str, role_col: str = "role", text_col: str = "text", options: dict[str, Column] | None = None) -> DataFrame:
    """session, key: the digest of tenant, model, all turns in order and the options that aren't null, by name: temperature, top_p and others, the same for a session's turns."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.concat_ws(":", role_col, text_col).alias("m"))))
    named = [F.min(F.concat(F.lit(f"{k}="), v.cast("string"))).alias(f"_{k}") for k, v in sorted((options or {}).items())]
    rows = turns.groupBy(session_col).agg(F.min(tenant).alias("_tenant"), listed.alias("_turns"), *named)
    whole = F.concat_ws("\x1f", F.col("_tenant").cast("string"), F.lit(model), F.array_join(F.transform("_turns", lambda t: t["m"]), "\x1f"), *[F.col(f"_{k}") for k in sorted(options or {})])
    return rows.select(session_col, F.sha2(whole, 256).alias("key"))


def chunks(text: Column, most: int) -> Column:
    """The text in pieces of at most `most` characters that never cut a placeholder; a longer placeholder stands alone."""
    units = F.regexp_extract_all(text, F.lit(r"<[A-Z_]+_[0-9]+>|(?s:.)"), F.lit(0))
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))
    full = lambda acc, u: (F.length(acc["now"]) > 0) & (F.length(acc["now"]) + F.length(u) > most)
    step = lambda acc, u: F.when(full(acc, u), F.struct(u.alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))).otherwise(F.struct(F.concat(acc["now"], u).alias("now"), acc["out"].alias("out")))
    return F.aggregate(units, start, step, lambda acc: F.when(F.length(acc["now"]) > 0, F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"]))


def entity_intent(text: Column, start: Column, end: Column) -> Column:
    """(is_question, confidence) of the use of an entity: by the whole text, then by what stands around it."""
    whole = T.is_question(text)
    near = F.substring(text, F.greatest(start - AROUND, F.lit(0)) + 1, end - F.greatest(start - AROUND, F.lit(0)) + AROUND)
    seen = lambda patterns: near.rlike(T.any_case("|".join(patterns)))
    sure = whole["is_question"] & (whole["confidence"] > 0.8)
    return F.struct((sure | seen(ASKED)).alias("is_question"), F.when(sure, 0.95).when(seen(ASKED), 0.85).when(seen(STATED), 0.9).otherwise(0.5).alias("confidence"))
