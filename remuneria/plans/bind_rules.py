"""Rule sets for the driver-table bindings.

The study's own keyword lists (``functions/rulesets.py``) are Spanish job
and company words; the driver tables carry part names such as "red plate"
or "large anvil", on which those lists would only ever give the default
label. The catalogue therefore runs every classifier operator with rule
sets of the SAME shape and policy (first / last / multi, contains / regex /
folded, defaults, thresholds) written over the driver vocabulary here; the
study's own lists run in ``q_rules.py`` on texts built from the tables.
"""

from __future__ import annotations

from ..functions.rules import Rule, RuleSet
from ..functions.rulesets import INSTITUTION_GRID_ORDER, INSTITUTION_TREE_ORDER, LEVEL_ORDER, ROLE_CAT_DISPLAY  # noqa: F401

# R1 shape: last match wins, company OR role.
SECTOR_LAST = RuleSet("B-R1", (
    Rule("Metal", ["anvil", "bolt", "rod"]),
    Rule("Mecanica", ["gear", "bolt"]),
    Rule("Gadgets", ["gizmo", "widget"]),
    Rule("Hogar", ["plate", "ring", "supplier#00000001"]),
), default="Otros", policy="last", mode="regex")

# R4 shape: first match wins, company.
SECTOR_FIRST = RuleSet("B-R4", (
    Rule("Banca", ["supplier#00000000"]),
    Rule("Mineria", ["supplier#00000001", "supplier#00000002"]),
    Rule("Retail", ["supplier#00000003", "supplier#0000001"]),
    Rule("Telecom", ["supplier#00000004", "supplier#00000005"]),
), default="Otros")

# R5 shape: 7 ordered levels, first match.
LEVEL = RuleSet("B-R5", (
    Rule("C-Level", ["large anvil", "large gear"]),
    Rule("VP / Director", ["large"]),
    Rule("Gerente", ["hot"]),
    Rule("Jefe / Subgerente", ["cold"]),
    Rule("Senior", ["new"]),
    Rule("Analista", ["old", "red"]),
    Rule("Junior", ["small", "blue"]),
), default="Otros")

# R6 shape (two labels + default) and R7 shape (three labels + default).
SENIORITY_SIMPLE = RuleSet("B-R6", (
    Rule("Senior", ["large", "hot"]),
    Rule("Junior", ["small", "cold"]),
), default="Mid-Level")
SENIORITY = RuleSet("B-R7", (
    Rule("Senior", ["large", "hot"]),
    Rule("Junior", ["small", "cold"]),
    Rule("Mid-Level", ["new", "old"]),
), default="Entry-Level")

# R8/R9 shape: overlapping labels, multi.
JOB_AREA = RuleSet("B-R8", (
    Rule("Metal", ["anvil", "bolt", "rod"]),
    Rule("Movimiento", ["gear", "rod", "ring"]),
    Rule("Color", ["red", "blue"]),
    Rule("Temperatura", ["hot", "cold"]),
), policy="multi", mode="regex")
CAREER_AREA = RuleSet("B-R9", (
    Rule("Tamano", ["large", "small"]),
    Rule("Edad", ["new", "old"]),
    Rule("Forma", ["ring", "plate", "rod"]),
    Rule("Aparato", ["gizmo", "widget", "gear"]),
    Rule("Letra", ["e"]),
), policy="multi", mode="regex")

# R10-R12 shape flags.
TI_WORDS = ["gear", "gizmo", "widget"]
MANAGER_WORDS = ["large", "hot"]
SALES_WORDS = ["red", "blue", "plate"]
TRAINEE_REGEX = "small|new "

# R13 shape within the TI scope.
TI_AREA = RuleSet("B-R13", (
    Rule("Senior TI", ["large", "hot"]),
    Rule("Data Science/Analytics", ["gizmo"]),
    Rule("Cloud/DevOps", ["cold gear", "blue gear"]),
    Rule("Development", ["widget"]),
    Rule("QA/Testing", ["red"]),
), default="TI General")

# R14 shape within the sales scope.
SALES_AREA = RuleSet("B-R14", (
    Rule("Senior Ventas/Marketing", ["new"]),
    Rule("Account Management", ["red plate", "blue plate"]),
    Rule("Marketing Digital", ["red"]),
    Rule("Ventas Directas", ["blue"]),
), default="Ventas/Marketing General")

# R15 shape: exact company scope, then role areas.
CONSUMER_COMPANIES = ["Supplier#000000001", "Supplier#000000002", "Supplier#000000003",
                      "Supplier#000000004", "Supplier#000000005", "Supplier#000000006",
                      "Supplier#000000007"]
CONSUMER_ROLE = RuleSet("B-R15", (
    Rule("Marketing y Marcas", ["red", "blue"]),
    Rule("Ventas y Comercial", ["plate", "ring"]),
    Rule("Producción y Supply Chain", ["anvil", "bolt"]),
    Rule("Control de Calidad", ["gear"]),
), default="Otros Roles Consumo Masivo")

# R16 shape: junior scope.
JUNIOR_REGEX = "small|cold.|new "
JUNIOR_EXCLUDED_TITLES = ["small anvil"]
LEADERSHIP_WORDS = ["large", "hot", "gear"]
CLEAR_JUNIOR_REGEX = r"\bsmall\b|\bnew\b"
JUNIOR_SALARY_CAP = 80000.0
JUNIOR_AREA = RuleSet("B-R17", (
    Rule("Metal Jr", ["anvil", "bolt", "rod"]),
    Rule("Aparato Jr", ["gizmo", "widget"]),
    Rule("Forma Jr", ["ring", "plate"]),
), default="Otros Practicantes/Juniors")

# R19 shape: banking scope and roles.
BANK_COMPANIES = ["Supplier#000000010", "Supplier#000000011", "Supplier#000000012"]
BANK_SECTOR_REGEX = "(?i)PROMO|ECONOMY"
BANK_ROLE = RuleSet("B-R19", (
    Rule("Gestión y Liderazgo", ["large", "hot"]),
    Rule("Asesoría y Ventas", ["red", "blue"]),
    Rule("Análisis y Especialización", ["new", "old"]),
    Rule("Riesgo y Cumplimiento", ["anvil"]),
), default="Otros Roles Bancarios")

# R20 shape: management levels (two rules share a label).
MANAGEMENT_LEVEL = RuleSet("B-R20", (
    Rule("C-Level Especializado", ["large anvil"]),
    Rule("C-Level/Presidencia", ["large gear", "large bolt"]),
    Rule("Gerentes Especializados", ["large"]),
    Rule("Gerentes Generales", ["hot anvil"]),
    Rule("Gerentes Especializados", ["hot"]),
), default="Otros Gerenciales")

# A40 shape: role families (13 in the study; here the part nouns).
ROLE_FAMILY = RuleSet("B-A40", tuple(Rule(n.title(), [n]) for n in
                                      ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]),
                      default=None)

# C8 shape.
RESCALE_PROFESSIONAL = "large|hot"
RESCALE_TRAINEE = "small"

# Public-calls shapes (R21-R24 on the calls binding).
ROLE_17 = RuleSet("B-R21", tuple(Rule(n, [n]) for n in
                                 ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]), default=None)
ROLE_CAT = RuleSet("B-R22", (
    Rule("Especialista", ["large"]),
    Rule("Coordinador", ["hot"]),
    Rule("Analista", ["cold"]),
    Rule("Profesional", ["new"]),
    Rule("Asistente", ["old"]),
    Rule("Auxiliar", ["small"]),
    Rule("Técnico", ["red", "blue"]),
), default=None)
PUBLIC_LEVEL = RuleSet("B-R23", (
    Rule("Gerente/Jefe", ["large"]),
    Rule("Coordinador/Esp.", ["hot", "new"]),
    Rule("Profesional", ["old"]),
    Rule("Asistente", ["red"]),
    Rule("Técnico", ["blue", "cold"]),
    Rule("Auxiliar/Apoyo", ["small"]),
), default=None)
PUBLIC_LEVEL_ORDER = ["Gerente/Jefe", "Coordinador/Esp.", "Profesional", "Asistente", "Técnico", "Auxiliar/Apoyo"]
# R24 shape: folded match on the institution text, then an exact lookup.
INSTITUTION_TYPE = RuleSet("B-R24", (
    Rule("Educación", ["africa supplier#0000000"]),
    Rule("Salud / Hospitales", ["américa", "amèrica"]),
    Rule("Justicia", ["asia supplier#00000001"]),
    Rule("Ministerios", ["asia"]),
    Rule("Municipalidades", ["europe supplier#0000000"]),
    Rule("Gobiernos Regionales", ["europe"]),
), default="Otros", mode="folded", exact={"middle east supplier#000000004": "Identidad / Civil"})
