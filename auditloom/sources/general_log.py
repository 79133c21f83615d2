"""General query log: the table form and the text form with its per-thread sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.cut import written
from auditloom.functions.segmented import last_known
from auditloom.functions.text import strip

# Line formats of the text log.
_STAMP = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z)\s+(\d+)\s+"
CONNECT_LINE = _STAMP + r"Connect\s+([^@]+)@(\S+)\s+on(?:\s+(\S+))?\s+using.*$"
QUERY_LINE = _STAMP + r"Query\s+(.+)$"
INIT_DB_LINE = _STAMP + r"Init DB\s+(\S+)"
QUIT_LINE = r"^\d{4}.*?\s+(\d+)\s+Quit"
USE_STATEMENT = r"(?i)^USE\s+`?([\w-]+)`?"


def read_general_log_table(df: DataFrame, own_marker: str = "AUDITLOOM_EVENT", own_user: str = "audit_monitor") -> DataFrame:
    """``Query`` rows of the log table; ``user_host`` is like ``user[user] @ host [ip]``."""
    host = F.regexp_extract("user_host", r"\[([^\]]*)\]", 1)
    return (df.where((F.col("command_type") == "Query") & ~F.col("user_host").startswith(f"{own_user}[")
                     & ~F.col("argument").contains(own_marker))
            .select(F.col("event_time").alias("timestamp"), F.trim(F.split_part("user_host", F.lit("["), F.lit(1))).alias("user"),
                    F.when(F.trim(host) == "", "N/A").otherwise(F.trim(host)).alias("client_ip"),
                    F.lit("N/A").alias("database"), F.col("argument").alias("query")))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: file, byte offset of the split, order inside the split."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), "value")


def classify_lines(lines: DataFrame) -> DataFrame:
    """Kind and fields of every line; a line that starts no command has kind null."""
    c = F.col("line")
    # The word tests are cheap and spare most lines the patterns of the other kinds.
    kind = (F.when(c.contains("Connect") & c.rlike(CONNECT_LINE), "connect").when(c.contains("Init DB") & c.rlike(INIT_DB_LINE), "init")
            .when(c.contains("Query") & c.rlike(QUERY_LINE), "query").when(c.contains("Quit") & c.rlike(QUIT_LINE), "quit"))
    out = lines.withColumn("line", strip(F.col("value"))).withColumn("kind", kind)
    kind = F.col("kind")
    return out.withColumns({
        "thread": F.when(kind == "quit", F.regexp_extract(c, QUIT_LINE, 1)).when(kind.isNotNull(), F.regexp_extract(c, _STAMP, 2)),
        "stamp": F.when(kind == "query", F.regexp_extract(c, QUERY_LINE, 1)),
        "c_user": F.when(kind == "connect", F.regexp_extract(c, CONNECT_LINE, 3)),
        "c_host": F.when(kind == "connect", F.regexp_extract(c, CONNECT_LINE, 4)),
        "c_db": F.when(kind == "connect", F.coalesce(_some(F.regexp_extract(c, CONNECT_LINE, 5)), F.lit("N/A"))),
        "i_db": F.when(kind == "init", F.regexp_extract(c, INIT_DB_LINE, 3)),
        "sql": F.when(kind == "query", F.regexp_extract(c, QUERY_LINE, 3))})


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def parse_general_log(lines: DataFrame, filter_user: str | None = None) -> DataFrame:
    """Statements of a text log with the user, host and database of their thread's session.

    ``lines``: file, block, pos, value; (block, pos) orders a file. Both steps that look back (which
    command a continuation line belongs to, which session a statement runs in) work per block and
    carry one row per block, so a large file is parsed in parallel.
    """
    # Lines are classified once, although the two steps read them four times.
    more = F.when(F.col("kind").isNull() & (F.col("line") != ""), F.col("value"))
    c = written(classify_lines(lines).withColumn("more", more).drop("line", "value"))
    if filter_user:
        c = c.where((F.col("kind").isNull()) | (F.col("kind") != "connect") | (F.col("c_user") != filter_user))
    at = F.struct("block", "pos")
    order = ["block", "pos"]

    # Continuation lines go to the latest command of the file, if that is a statement.
    # Only their text travels with them; command lines are reduced to their place here.
    slim = c.select("file", "block", "pos", "kind", "more")
    shape = last_known(slim, ["file"], order, {"owner": F.when(F.col("kind").isNotNull(), F.struct(F.col("kind").alias("k"), at.alias("at")))},
                       F.col("block"))
    # A statement is one value in the end, so its lines may meet in one list.
    tails = (shape.where(F.col("more").isNotNull() & (F.col("owner.k") == "query"))
             .select("file", F.col("owner.at").alias("at"), at.alias("o"), "more")
             .groupBy("file", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "more"))),
                                                                 lambda s: s["more"]), "\n").alias("tail")))

    opened = F.when(F.col("kind") == "connect", F.struct(F.lit(True).alias("open"), F.col("c_user").alias("user"), F.col("c_host").alias("host")))
    closed = F.when(F.col("kind") == "quit", F.struct(F.lit(False).alias("open"), F.lit(None).cast("string").alias("user"),
                                                      F.lit(None).cast("string").alias("host")))
    used = F.when(F.col("kind") == "query", _some(F.regexp_extract("sql", USE_STATEMENT, 1)))
    commands = c.where(F.col("kind").isNotNull()).select("file", "block", "pos", "kind", "thread", "stamp", "c_user", "c_host", "c_db", "i_db", "sql")
    sessions = last_known(commands, ["file", "thread"], order, {
        "session": F.coalesce(opened, closed), "db": F.coalesce(F.col("c_db"), F.col("i_db"), used)}, F.col("block"))
    stmts = sessions.where((F.col("kind") == "query") & F.col("session.open")).withColumn("at", at)
    return (stmts.join(tails, ["file", "at"], "left").select(
        F.to_timestamp("stamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX").alias("timestamp"), "file", "block", "pos", "thread",
        F.col("session.user").alias("user"), F.col("session.host").alias("client_ip"), F.col("db").alias("database"),
        strip(F.concat_ws("\n", "sql", "tail")).alias("query")))


def session_state(lines: DataFrame, filter_user: str | None = None) -> DataFrame:
    """Open sessions at the end of the lines: what the next batch needs (file, thread, user, host, db)."""
    c = classify_lines(lines).where("kind is not null")
    if filter_user:
        c = c.where((F.col("kind") != "connect") | (F.col("c_user") != filter_user))
    at = F.struct("block", "pos")
    used = F.when(F.col("kind") == "query", _some(F.regexp_extract("sql", USE_STATEMENT, 1)))
    db = F.coalesce(F.col("c_db"), F.col("i_db"), used)
    change = F.col("kind").isin("connect", "quit")
    ends = c.groupBy("file", "thread").agg(
        F.max_by(F.struct(F.col("kind").alias("k"), F.col("c_user").alias("user"), F.col("c_host").alias("host")), F.when(change, at)).alias("s"),
        F.max_by(db, F.when(db.isNotNull(), at)).alias("db"))
    return ends.where("s.k = 'connect'").select("file", "thread", "s.user", "s.host", "db")


def state_lines(state: DataFrame) -> DataFrame:
    """Carried sessions as Connect lines that precede every real line."""
    value = F.concat(F.lit("1970-01-01T00:00:00.000000Z "), "thread", F.lit(" Connect "), "user", F.lit("@"), "host",
                     F.lit(" on "), F.when(F.col("db") == "N/A", "").otherwise(F.concat("db", F.lit(" "))), F.lit("using carried"))
    return state.select("file", F.lit(-1).cast("long").alias("block"), F.xxhash64("thread").alias("pos"), value.alias("value"))
