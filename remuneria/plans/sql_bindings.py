"""The driver-table bindings written as DuckDB CTEs for the oracle SQL.
Same mapping as ``sources/bindings.py`` (survey §7.3)."""

POSTINGS = """postings AS (
  SELECT l.l_orderkey * 100 + l.l_linenumber AS posting_id,
         s.s_name AS empresa, p.p_name AS puesto, p.p_type AS sector,
         p.p_brand AS universidad_principal,
         l.l_extendedprice * (1 - l.l_discount) AS salario_minimo,
         l.l_extendedprice * (1 + l.l_tax) AS salario_maximo,
         l.l_extendedprice AS salario_promedio,
         CAST(l.l_shipdate AS DATE) AS fecha_inicio,
         l.l_shipdate AS fecha_extraccion
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
                  JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""

CALLS = """calls AS (
  SELECT r.r_name || ' ' || s.s_name AS institucion, p.p_name AS puesto,
         n.n_name AS departamento, l.l_extendedprice / 10 AS salario,
         strftime(l.l_shipdate, '%d/%m/%Y') AS fecha_limite,
         'http://calls/' || CAST(l.l_orderkey AS VARCHAR) || '/' || CAST(l.l_linenumber AS VARCHAR) AS url,
         l.l_shipdate AS fecha_extraccion
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
                  JOIN supplier s ON l.l_suppkey = s.s_suppkey
                  JOIN nation n ON s.s_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

OBSERVATIONS = """obs AS (
  SELECT 'http://calls/u' || CAST(user_id AS VARCHAR) || '/' || event_type AS url,
         CAST(ts AS DATE) AS seen_date, ts AS seen_ts,
         'Entidad ' || CAST(user_id AS VARCHAR) AS institucion,
         event_type AS puesto, 'LIMA' AS departamento, value * 100 AS salario,
         strftime(CAST(ts AS DATE) + 7, '%d/%m/%Y') AS fecha_limite
  FROM events)"""

HISTORY = OBSERVATIONS + """,
hist AS (
  SELECT url,
         arg_max(institucion, (seen_ts, institucion, puesto, departamento, salario, fecha_limite)) AS institucion, arg_max(puesto, (seen_ts, institucion, puesto, departamento, salario, fecha_limite)) AS puesto,
         arg_max(departamento, (seen_ts, institucion, puesto, departamento, salario, fecha_limite)) AS departamento, arg_max(salario, (seen_ts, institucion, puesto, departamento, salario, fecha_limite)) AS salario,
         arg_max(fecha_limite, (seen_ts, institucion, puesto, departamento, salario, fecha_limite)) AS fecha_limite,
         min(seen_date) AS primera_vez_visto, max(seen_date) AS ultima_vez_visto,
         CASE WHEN max(seen_date) = (SELECT max(seen_date) FROM obs) THEN 'vigente' ELSE 'expirada' END AS estado
  FROM obs GROUP BY url)"""

PAYROLL = """payroll AS (
  SELECT strftime(l.l_shipdate, '%Y%m') AS PERIODO, CAST(year(l.l_shipdate) AS INTEGER) AS year,
         r.r_name AS NIVEL, c.c_mktsegment AS SECTOR, n.n_name AS PLIEGO,
         CAST(l.l_suppkey AS VARCHAR) AS UNIDAD_EJECUTORA,
         CASE l.l_returnflag WHEN 'R' THEN 'Activos'
                             WHEN 'A' THEN 'Contrato Administrativo de Servicios'
                             ELSE 'Pensionistas' END AS DESC_TIPO_REGISTRO,
         CASE WHEN l.l_linestatus = 'O' THEN 'OCUPADO' ELSE 'VACANTE' END AS ESTADO_REGISTRO,
         o.o_orderpriority AS DESC_REGIMEN_LABORAL, p.p_type AS DESC_GRUPO_OCASIONAL,
         CAST(l.l_quantity AS INTEGER) AS CANTIDAD,
         l.l_extendedprice AS ING_IMPONIBLE_PERM_MENSUAL,
         l.l_extendedprice * l.l_discount AS ING_NO_IMPONIBLE_PERM_MENSUAL,
         l.l_extendedprice * l.l_tax AS INCENTIVO_UNICO_MENSUAL,
         l.l_extendedprice * 12 AS COSTO_TOTAL_ANUAL
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN customer c ON o.o_custkey = c.c_custkey
                  JOIN nation n ON c.c_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey
                  JOIN part p ON l.l_partkey = p.p_partkey),
snap_year AS (
  SELECT y.* FROM payroll y
  JOIN (SELECT year AS yy, max(PERIODO) AS mp FROM payroll GROUP BY year) m
    ON y.year = m.yy AND y.PERIODO = m.mp
  WHERE y.ESTADO_REGISTRO = 'OCUPADO'
    AND y.DESC_TIPO_REGISTRO IN ('Activos', 'Contrato Administrativo de Servicios')),
snap AS (
  SELECT * FROM payroll
  WHERE PERIODO = (SELECT max(PERIODO) FROM payroll)
    AND ESTADO_REGISTRO = 'OCUPADO'
    AND DESC_TIPO_REGISTRO IN ('Activos', 'Contrato Administrativo de Servicios'))"""

# income per head (A31) as SQL text
HEADS = "CAST(sum(coalesce(CANTIDAD, 0)) AS BIGINT)"
ING_PROM = ("CASE WHEN sum(coalesce(CANTIDAD, 0)) = 0 THEN 0.0 ELSE "
            "sum(coalesce(ING_IMPONIBLE_PERM_MENSUAL, 0) + coalesce(ING_NO_IMPONIBLE_PERM_MENSUAL, 0)"
            " + coalesce(INCENTIVO_UNICO_MENSUAL, 0)) / sum(coalesce(CANTIDAD, 0)) END")
