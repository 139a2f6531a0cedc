"""Call-history queries (survey H1-H3 A37 U1 W4 C14 C15 C17 Z1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..sources import bindings as B
from ..streaming import merge as M
from .registry import query
from .sql_bindings import HISTORY

W = f"WITH {HISTORY}"
# The as-of date is a parameter of the feed (never now()). The events cover
# January 2024 and every call is first seen in its first days: as of
# 2024-01-03 some calls are in the window and some aren't known yet.
AS_OF = "2024-01-03"


def _hist(spark, sf):
    return H.merge_observations(B.observations(spark, sf))


_MERGED_SQL = f"""{W}
SELECT url, institucion, puesto, departamento, round(salario, 4) AS salario, fecha_limite,
       CAST(primera_vez_visto AS VARCHAR) AS primera_vez_visto, CAST(ultima_vez_visto AS VARCHAR) AS ultima_vez_visto,
       estado FROM hist"""


def _published(df):
    return df.select("url", "institucion", "puesto", "departamento", F.round("salario", 4).alias("salario"),
                     "fecha_limite", F.col("primera_vez_visto").cast("string").alias("primera_vez_visto"),
                     F.col("ultima_vez_visto").cast("string").alias("ultima_vez_visto"), "estado")


@query("history_merge_batch", "Z1 U2", _MERGED_SQL)
def history_merge_batch(spark, sf):
    return _published(_hist(spark, sf))


@query("history_merge_stream", "Z1", _MERGED_SQL)
def history_merge_stream(spark, sf):
    """The same merge as a Structured Streaming job (availableNow trigger)
    over the events table (a file or a folder), read back from its log.
    Runs the stream while the query is built."""
    return _published(M.run_merge_stream(spark, f"{sf}/events.parquet"))


@query("history_merge_stream_expiring", "Z1", _MERGED_SQL)
def history_merge_stream_expiring(spark, sf):
    """Z1 with a bounded log: every batch is merged into the stored history
    and its changes are deleted. Runs the stream while the query is built."""
    return _published(M.run_merge_stream(spark, f"{sf}/events.parquet", compact_every=1))


@query("history_trend", "H1 U1 W4", f"""{W},
d AS (SELECT primera_vez_visto AS fecha FROM hist UNION SELECT ultima_vez_visto FROM hist),
n AS (SELECT primera_vez_visto AS fecha, count(*) AS nuevas FROM hist GROUP BY 1),
a AS (SELECT ultima_vez_visto AS fecha, count(*) AS vigentes FROM hist GROUP BY 1)
SELECT CAST(d.fecha AS VARCHAR) AS fecha, coalesce(n.nuevas, 0) AS nuevas, coalesce(a.vigentes, 0) AS vigentes,
       CAST(sum(coalesce(n.nuevas, 0)) OVER (ORDER BY d.fecha ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS acumulado
FROM d LEFT JOIN n ON n.fecha = d.fecha LEFT JOIN a ON a.fecha = d.fecha WHERE d.fecha IS NOT NULL""")
def history_trend(spark, sf):
    t = H.trend(_hist(spark, sf))
    return t.withColumn("fecha", F.col("fecha").cast("string"))


_RECENT = f"""recent AS (SELECT * FROM hist WHERE primera_vez_visto BETWEEN DATE '{AS_OF}' - 14 AND DATE '{AS_OF}'
                          AND url IS NOT NULL AND trim(url) <> ''
                          ORDER BY primera_vez_visto DESC, url DESC LIMIT 200)"""


@query("history_recent", "H2", f"""{W}, {_RECENT}
SELECT url, CAST(primera_vez_visto AS VARCHAR) AS primera_vez_visto, estado FROM recent""")
def history_recent(spark, sf):
    r = H.recent(_hist(spark, sf), AS_OF, days=14, limit=200)
    return r.select("url", F.col("primera_vez_visto").cast("string").alias("primera_vez_visto"), "estado")


FEED_SQL = f"""{W}, {_RECENT},
f AS (SELECT *, CASE WHEN salario > 0 AND floor(salario) <> 0
                     THEN 'S/ ' || format('{{:,}}', CAST(floor(salario) AS BIGINT)) ELSE '(salario no reportado)' END AS sal,
             coalesce(nullif(trim(institucion), ''), '(sin institución)') AS inst,
             coalesce(nullif(trim(puesto), ''), '(sin puesto)') AS role,
             coalesce(nullif(trim(departamento), ''), '—') AS dept,
             coalesce(nullif(trim(fecha_limite), ''), '—') AS lim, coalesce(estado, 'vigente') AS st FROM recent)
SELECT trim(url) AS id, role || ' @ ' || inst || ' — ' || sal AS title,
       role || ' en ' || inst || '. Departamento: ' || dept || '. Salario: ' || sal || '. Postular hasta: ' || lim
            || '. Estado: ' || st || '.' AS summary,
       strftime(CAST(primera_vez_visto AS TIMESTAMP) + INTERVAL 12 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS published,
       strftime(CAST(coalesce(ultima_vez_visto, primera_vez_visto) AS TIMESTAMP) + INTERVAL 12 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS updated,
       dept AS category_place, st AS category_state FROM f"""


@query("history_feed_entries", "H3 C14 C15 C17", FEED_SQL)
def history_feed_entries(spark, sf):
    r = H.recent(_hist(spark, sf), AS_OF, days=14, limit=200)
    return H.feed_entries(r, AS_OF)


@query("history_states", "A37", f"""{W}
SELECT count_if(estado = 'vigente') AS vigentes, count_if(estado = 'expirada') AS expiradas FROM hist""")
def history_states(spark, sf):
    return H.state_counts(_hist(spark, sf))
