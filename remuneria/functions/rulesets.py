"""Rule sets R1-R27 as data.

Fixed values: the labels, keyword lists, their order and the thresholds
below must equal the ones the pay study uses, or the labels differ. They are
stated as plain text in their natural (matching) order. Keywords are
lower-case; see ``rules.py`` for how each policy/mode is compiled.
"""

from __future__ import annotations

from .rules import Rule, RuleSet

# ---------------------------------------------------------------- fixed values
# R1 sector, company OR role, LAST match wins, regex mode (pandas default).
SECTOR_FULL = RuleSet("R1", (
    Rule("Banca y Finanzas", ["bcp", "bbva", "interbank", "credicorp", "banco", "scotiabank",
                              "yape", "plin", "culqi", "izipay", "financiera", "credito"]),
    Rule("Tecnología", ["tech", "software", "ibm", "microsoft", "google", "oracle", "sap",
                        "accenture", "tcs", "globant", "data", "developer", "programmer"]),
    Rule("Consultoría", ["ey", "deloitte", "pwc", "kpmg", "mckinsey", "bcg", "bain",
                         "consulting", "consultant", "advisory"]),
    Rule("Telecomunicaciones", ["entel", "movistar", "claro", "bitel", "telecom", "telefonica"]),
    Rule("Consumo Masivo", ["alicorp", "gloria", "nestle", "unilever", "procter", "gamble",
                            "retail", "falabella", "ripley", "tottus", "wong", "plaza"]),
    Rule("Seguros", ["rimac", "pacifico", "seguros", "insurance", "reaseguros"]),
    Rule("Bebidas", ["ab inbev", "backus", "coca cola", "pepsi", "cerveza"]),
    Rule("Cosmética", ["loreal", "l'oreal", "nivea", "cosmetic", "beauty"]),
    Rule("Minería", ["antamina", "southern", "volcan", "buenaventura", "cerro verde", "mining"]),
    Rule("Energía", ["enel", "luz del sur", "electroandes", "energy", "electric"]),
), default="Otros", policy="last", mode="regex")

# R2 sector, shorter lists, LAST match wins.
SECTOR_SHORT = RuleSet("R2", (
    Rule("Banca y Finanzas", ["bcp", "bbva", "interbank", "banco", "scotiabank", "yape", "culqi"]),
    Rule("Tecnología", ["tech", "software", "microsoft", "google", "data", "developer"]),
    Rule("Consultoría", ["deloitte", "pwc", "kpmg", "mckinsey", "consulting"]),
    Rule("Telecomunicaciones", ["entel", "movistar", "claro", "telefonica"]),
    Rule("Consumo Masivo", ["alicorp", "gloria", "nestle", "unilever", "falabella", "ripley"]),
    Rule("Seguros", ["rimac", "seguros", "insurance"]),
    Rule("Bebidas", ["ab inbev", "backus", "coca cola"]),
    Rule("Cosmética", ["loreal", "cosmetic"]),
    Rule("Minería", ["antamina", "southern", "volcan", "mining"]),
    Rule("Energía", ["enel", "energy", "electric"]),
), default="Otros", policy="last", mode="regex")

# R3 sector, company only, LAST match wins.
SECTOR_COMPANY = RuleSet("R3", (
    Rule("Banca y Finanzas", ["bcp", "bbva", "interbank", "credicorp", "banco"]),
    Rule("Tecnología", ["yape", "culqi", "google", "microsoft", "tech"]),
    Rule("Consumo Masivo", ["alicorp", "procter", "gamble", "unilever", "nestle"]),
    Rule("Consultoría", ["ey", "deloitte", "pwc", "kpmg", "mckinsey"]),
    Rule("Telecomunicaciones", ["entel", "movistar", "claro", "telecom"]),
    Rule("Seguros", ["rimac", "seguros", "insurance"]),
    Rule("Bebidas", ["ab inbev", "coca cola", "pepsi"]),
    Rule("Cosmética", ["loreal", "l'oreal", "cosmetic"]),
), default="Otros", policy="last", mode="regex")

# R4 sector by company, FIRST match wins.
SECTOR_DASHBOARD = RuleSet("R4", (
    Rule("Banca", ["banco", "bcp", "interbank", "bbva", "scotiabank", "mibanco", "banbif",
                   "credicorp", "financier", "pichincha"]),
    Rule("Seguros", ["seguro", "rimac", "pacifico", "mapfre", "interseguro", "positiva"]),
    Rule("Mineria", ["minera", "minsur", "antamina", "glencore", "southern", "cerro verde",
                     "brocal", "buenaventura", "shougang", "nexa"]),
    Rule("Consumo Masivo", ["alicorp", "nestle", "backus", "inbev", "gloria", "san fernando",
                            "mondelez", "pepsico", "ajinomoto"]),
    Rule("Consultoria", ["deloitte", "ey", "ernst", "pwc", "kpmg", "mckinsey", "bcg", "boston",
                         "accenture", "management solutions"]),
    Rule("Fintech / Tech", ["culqi", "yape", "rappi", "izipay", "kushki", "vtex", "crehana",
                            "jokr", "pedidosya", "despegar"]),
    Rule("Cosmeticos", ["loreal", "belcorp", "yanbal", "procter", "colgate", "kimberly",
                        "reckitt", "estee"]),
    Rule("Retail", ["falabella", "ripley", "sodimac", "tottus", "hiraoka", "oxxo", "makro",
                    "plaza vea", "cencosud"]),
    Rule("Telecom", ["entel", "telefonica", "claro", "bitel", "movistar"]),
    Rule("Logistica", ["latam", "ransa", "dp world", "sky airline", "talma", "dhl"]),
), default="Otros")

# R5 hierarchy level by role, FIRST match wins ('gerente' precedes
# 'subgerente', so 'Subgerente' is labelled Gerente).
LEVEL = RuleSet("R5", (
    Rule("C-Level", ["ceo", "chief", "gerente general", "presidente", "vp ejecutivo"]),
    Rule("VP / Director", ["vp ", "vice president", "director", "managing director"]),
    Rule("Gerente", ["gerente", "manager", "head of", "lead"]),
    Rule("Jefe / Subgerente", ["subgerente", "sub gerente", "jefe", "superintendent", "supervisor"]),
    Rule("Senior", ["senior", "sr ", "sr.", "specialist", "especialista"]),
    Rule("Analista", ["analista", "analyst", "ejecutivo", "consultant", "consultor"]),
    Rule("Junior", ["asistente", "assistant", "trainee", "practicante", "junior", "jr"]),
), default="Otros")
LEVEL_ORDER = ["C-Level", "VP / Director", "Gerente", "Jefe / Subgerente", "Senior", "Analista", "Junior"]

# R6 seniority ('analista' counts as Junior here).
SENIORITY_SIMPLE = RuleSet("R6", (
    Rule("Senior", ["senior", "sr", "lead", "principal", "manager", "gerente"]),
    Rule("Junior", ["junior", "jr", "trainee", "analyst", "analista"]),
), default="Mid-Level")

# R7 seniority, four levels.
SENIORITY = RuleSet("R7", (
    Rule("Senior", ["senior", "sr", "lead", "principal", "manager", "gerente", "director",
                    "chief", "head", "supervisor", "coordinator"]),
    Rule("Junior", ["junior", "jr", "trainee", "intern", "practicante", "asistente",
                    "assistant", "apprentice"]),
    Rule("Mid-Level", ["analyst", "analista", "specialist", "especialista", "professional",
                       "officer", "executive"]),
), default="Entry-Level")
# R7 variant used by the web dashboard (no supervisor/coordinator/apprentice).
SENIORITY_WEB = RuleSet("R7w", (
    Rule("Senior", ["senior", "sr", "lead", "principal", "manager", "gerente", "director",
                    "chief", "head"]),
    Rule("Junior", ["junior", "jr", "trainee", "intern", "practicante", "asistente", "assistant"]),
    Rule("Mid-Level", ["analyst", "analista", "specialist", "especialista", "professional",
                       "officer", "executive"]),
), default="Entry-Level")
SENIORITY_ORDINAL = {"Junior": 1, "Entry-Level": 2, "Mid-Level": 3, "Senior": 4}

# R8 job area, overlapping labels (multi).
JOB_AREA = RuleSet("R8", (
    Rule("Gerencial", ["gerente", "manager", "director", "jefe", "chief", "head"]),
    Rule("Técnico", ["developer", "programador", "ingeniero", "técnico", "analista", "specialist"]),
    Rule("Ventas", ["ventas", "sales", "comercial", "vendedor"]),
    Rule("Marketing", ["marketing", "brand", "digital", "social media", "publicidad"]),
    Rule("Finanzas", ["financiero", "contable", "controller", "tesorería", "crédito"]),
    Rule("RRHH", ["recursos humanos", "rrhh", "hr", "talent", "people"]),
    Rule("Operaciones", ["operaciones", "logistics", "supply", "procurement", "compras"]),
    Rule("Consultoría", ["consultant", "consultor", "advisory", "business"]),
), policy="multi", mode="regex")

# R9 career area, overlapping labels (multi); 'it' is very broad on purpose.
CAREER_AREA = RuleSet("R9", (
    Rule("Ingeniería de Sistemas/Software", ["developer", "programador", "software", "systems", "it", "tech"]),
    Rule("Administración/MBA", ["manager", "gerente", "director", "administration", "business"]),
    Rule("Marketing/Comunicaciones", ["marketing", "brand", "communication", "digital", "social"]),
    Rule("Finanzas/Contabilidad", ["financial", "financiero", "contable", "accounting", "controller"]),
    Rule("Ingeniería Industrial", ["operations", "logistics", "supply", "process", "industrial"]),
    Rule("Economía", ["economist", "economic", "research", "planning", "strategy"]),
    Rule("Psicología/RRHH", ["hr", "human resources", "talent", "people", "recruitment"]),
    Rule("Derecho", ["legal", "compliance", "regulatory", "counsel"]),
    Rule("Ingeniería Civil/Construcción", ["construction", "civil", "project manager", "infrastructure"]),
    Rule("Medicina/Salud", ["medical", "health", "safety", "occupational"]),
), policy="multi", mode="regex")

# R10-R12 flags.
TI_WORDS = [
    "desarrollador", "developer", "programador", "programmer",
    "ingeniero de software", "software engineer", "devops",
    "analista de sistemas", "systems analyst", "qa", "testing",
    "arquitecto de software", "tech lead", "scrum master",
    "data scientist", "data analyst", "big data", "machine learning",
    "frontend", "backend", "fullstack", "mobile developer",
    "cybersecurity", "seguridad informatica", "cloud", "aws", "azure",
]
MANAGER_WORDS = [
    "gerente", "director", "jefe", "head", "chief", "presidente",
    "ceo", "cfo", "cto", "manager", "supervisor", "coordinador",
    "lead", "líder", "encargado",
]
SALES_WORDS = [
    "vendedor", "ventas", "sales", "comercial", "account manager",
    "business development", "key account", "inside sales",
    "marketing", "brand", "digital marketing", "social media",
    "community manager", "seo", "sem", "publicidad", "advertising",
    "market research", "product marketing", "growth",
]
# Trainee regex of the KPI cards (pandas regex: 'jr.' = jr + any char).
TRAINEE_REGEX = "practicante|trainee|intern|junior|jr.|jr |auxiliar"

# R13 TI sub-area ('tech lead' never reaches Tech Leadership: 'lead' is Senior TI).
TI_AREA = RuleSet("R13", (
    Rule("Senior TI", ["senior", "sr.", "lead", "principal", "architect"]),
    Rule("Data Science/Analytics", ["data scientist", "data analyst", "big data", "machine learning"]),
    Rule("Cloud/DevOps", ["cloud", "devops", "infrastructure", "aws", "azure"]),
    Rule("Cybersecurity", ["cybersecurity", "security", "seguridad"]),
    Rule("Development", ["frontend", "backend", "fullstack", "mobile", "web"]),
    Rule("QA/Testing", ["qa", "testing", "quality"]),
    Rule("Tech Leadership", ["tech lead", "scrum master", "product owner"]),
), default="TI General")

# R14 sales/marketing sub-area.
SALES_AREA = RuleSet("R14", (
    Rule("Senior Ventas/Marketing", ["senior", "sr.", "principal"]),
    Rule("Account Management", ["account manager", "key account", "business development"]),
    Rule("Marketing Digital", ["digital marketing", "social media", "seo", "sem"]),
    Rule("Ventas Directas", ["inside sales", "sales representative", "vendedor"]),
    Rule("Brand/Product Marketing", ["brand", "product marketing"]),
    Rule("Research/Analytics", ["market research", "analyst", "research"]),
), default="Ventas/Marketing General")

# R15 consumer-goods scope (exact company names) and role areas.
CONSUMER_COMPANIES = [
    "Agro Industrial Paramonga Saa", "Backus", "Super Food Holding", "Alicorp",
    "Colgate-Palmolive", "Procter & Gamble", "Reckitt",
]
CONSUMER_ROLE = RuleSet("R15", (
    Rule("Marketing y Marcas", ["marketing", "marca", "brand", "trade"]),
    Rule("Ventas y Comercial", ["ventas", "sales", "comercial", "account"]),
    Rule("Producción y Supply Chain", ["producción", "production", "planta", "manufacturing", "supply"]),
    Rule("Control de Calidad", ["calidad", "quality", "control", "aseguramiento"]),
    Rule("Finanzas y Planeamiento", ["finanzas", "finance", "planeamiento", "planning", "analyst"]),
    Rule("I+D e Innovación", ["investigación", "research", "desarrollo", "innovation", "design"]),
    Rule("Gestión y Liderazgo", ["gerente", "manager", "director", "jefe", "head", "ceo"]),
), default="Otros Roles Consumo Masivo")

# R16 junior scope.
JUNIOR_REGEX = "practicante|trainee|intern|junior|jr.|jr |auxiliar"
JUNIOR_EXCLUDED_TITLES = [
    "Jefe de comunicación interna y gestión del cambio",
    "Chile International and National Senior Transport Manager",
]
LEADERSHIP_WORDS = ["jefe", "head", "manager", "director", "gerente", "supervisor", "senior"]
CLEAR_JUNIOR_REGEX = r"\bjunior\b|\bjr\b"
JUNIOR_SALARY_CAP = 8000.0          # 5000.0 in the stricter dashboard variant

# R17 junior area ('ti' also hits words such as 'practicante'... in order).
JUNIOR_AREA = RuleSet("R17", (
    Rule("Marketing y Comercial Jr", ["marketing", "marca", "brand", "comercial", "ventas", "sales"]),
    Rule("Finanzas y Análisis Jr", ["finanzas", "finance", "planeamiento", "planning", "revenue", "analyst"]),
    Rule("Tecnología Jr", ["ti", "tecnología", "sistemas", "proyectos ti", "tech"]),
    Rule("Recursos Humanos Jr", ["recursos humanos", "rrhh", "hr", "talento", "selección"]),
    Rule("Supply Chain y Operaciones Jr", ["supply", "logística", "cadena", "operaciones", "operations"]),
    Rule("Consultoría y Negocios Jr", ["consultoría", "consulting", "business", "estrategia"]),
    Rule("Comunicaciones Jr", ["comunicación", "communication", "interno", "clima"]),
), default="Otros Practicantes/Juniors")

# R18 tech scope.
TECH_COMPANIES = [
    "Culqi", "Yape", "Rappi", "Bcp Lab", "Entel Perú", "Telefónica", "Claro", "Bitel",
    "Movistar", "Rimac Seguros", "BCP Digital", "Interbank Digital", "Scotiabank Digital",
    "IBM", "Microsoft", "Oracle", "SAP", "Accenture", "Deloitte Digital", "EY Tech",
]
TECH_SECTOR_REGEX = "(?i)Tecnología|Telecomunicaciones|Software|Digital"
TECH_ROLE_WORDS = [
    "developer", "programador", "software", "data", "analytics", "devops", "cloud",
    "cybersecurity", "qa", "testing", "frontend", "backend", "fullstack", "mobile",
    "systems", "network", "infrastructure", "database", "architect", "engineer",
]

# R19 banking scope and roles.
BANK_COMPANIES = ["Banco de Crédito BCP", "Interbank", "BBVA Perú", "Scotiabank Perú",
                  "Banco de la Nación", "Credicorp"]
BANK_SECTOR_REGEX = "(?i)Banca|Financiero|Seguros"
BANK_ROLE = RuleSet("R19", (
    Rule("Gestión y Liderazgo", ["gerente", "director", "jefe", "head"]),
    Rule("Asesoría y Ventas", ["asesor", "ejecutivo", "consultor"]),
    Rule("Análisis y Especialización", ["analista", "analyst", "especialista"]),
    Rule("Riesgo y Cumplimiento", ["riesgo", "risk", "cumplimiento"]),
    Rule("Operaciones", ["operaciones", "operations", "procesos"]),
), default="Otros Roles Bancarios")

# R20 management level.
MANAGEMENT_LEVEL = RuleSet("R20", (
    Rule("C-Level Especializado", ["ceo", "presidente", "chief executive", "director general"]),
    Rule("C-Level/Presidencia", ["cfo", "cto", "coo", "chief"]),
    Rule("Gerentes Especializados", ["director", "directora"]),
    Rule("Gerentes Generales", ["gerente general", "general manager"]),
    Rule("Gerentes Especializados", ["gerente", "manager"]),
    Rule("Jefaturas/Heads", ["jefe", "head", "líder", "lead"]),
    Rule("Supervisión/Coordinación", ["supervisor", "coordinador", "encargado"]),
), default="Otros Gerenciales")

# R21 granular public role (label = keyword, accents kept).
ROLE_17_LABELS = [
    "Médico", "Especialista", "Ingeniero", "Coordinador", "Analista",
    "Profesional", "Abogado", "Psicólogo", "Jefe", "Gerente",
    "Enfermero", "Asistente", "Operador", "Técnico", "Auxiliar",
    "Chofer", "Secretario",
]
ROLE_17 = RuleSet("R21", tuple(Rule(lab, [lab.lower()]) for lab in ROLE_17_LABELS), default=None)

# R22 role category (match order differs from display order).
ROLE_CAT = RuleSet("R22", (
    Rule("Especialista", ["especialista"]),
    Rule("Coordinador", ["coordinador"]),
    Rule("Analista", ["analista"]),
    Rule("Profesional", ["profesional"]),
    Rule("Asistente", ["asistente"]),
    Rule("Auxiliar", ["auxiliar"]),
    Rule("Técnico", ["técnico", "tecnico"]),
), default=None)
ROLE_CAT_DISPLAY = ["Especialista", "Coordinador", "Profesional", "Analista", "Asistente", "Técnico", "Auxiliar"]

# R23 public level.
PUBLIC_LEVEL = RuleSet("R23", (
    Rule("Gerente/Jefe", ["gerente", "jefe", "director", "subgerente", "sub gerente"]),
    Rule("Coordinador/Esp.", ["coordinador", "especialista", "supervisor"]),
    Rule("Profesional", ["profesional", "médico", "medico", "abogado", "psicólogo",
                         "psicologo", "ingeniero", "enfermer", "arquitect", "contador",
                         "economista", "biólog", "biolog"]),
    Rule("Asistente", ["asistente", "analista", "ejecutivo"]),
    Rule("Técnico", ["técnico", "tecnico", "operador", "chofer"]),
    Rule("Auxiliar/Apoyo", ["auxiliar", "apoyo", "secretario", "secretaria", "asistencial"]),
), default=None)

# R24 institution type: accent-insensitive, first match, then exact acronyms.
INSTITUTION_TYPE = RuleSet("R24", (
    Rule("Identidad / Civil", ["reniec", "migraciones", "registro nacional", "registro civil"]),
    Rule("Justicia", ["poder judicial", "fiscalía", "fiscalia", "fiscal de",
                      "fiscal superior", "ministerio público", "ministerio publico",
                      "tribunal", "corte superior", "corte suprema", "inpe",
                      "academia de la magistratura", "procuraduría", "procuraduria",
                      "defensoría", "defensoria", "ministerio de justicia", "minjus"]),
    Rule("Salud / Hospitales", ["hospital", "red de salud", "red asistencial",
                                "essalud", "saludpol", "instituto nacional de salud",
                                "instituto nacional materno", "instituto nacional del niño",
                                "instituto nacional oftalm", "instituto nacional neurol",
                                "inen", "insn", "ino ", "ips ",
                                "diresa", "dirección regional salud", "dirección regional de salud",
                                "dirección de salud", "geresa", "salud huallaga", "salud junin",
                                "salud ", "centro de salud", " sis ", "sis ", " sis"]),
    Rule("Educación", ["universidad", "escuela", "colegio nacional",
                       "instituto pedagógico", "instituto tecnológico",
                       "instituto superior", "minedu", "ministerio de educación",
                       "pronabec", "sineace", "peip", "pronied", "inictel",
                       "ugel", "dre ", "dre-", "dre)", "dreli", "drep",
                       "unidad de gestión educativa", "unidad de gestion educativa",
                       "dirección de educación", "dirección regional educación",
                       "dirección regional de educación", "drec", "drelm"]),
    Rule("Sup. y Fiscalización", ["sunat", "sunafil", "sunarp", "sbs", "indecopi",
                                  "osce", "osinergmin", "osiptel", "sutran", "ositran",
                                  "osinfor", "contraloría", "contraloria", "indeci",
                                  "sunedu", "oefa", "sucamec", "senasa", "serfor",
                                  "smv ", "smv-", "ana ", "ana-", "autoridad nacional del agua",
                                  "atu ", "atu-", "autoridad de transporte", "cenepred",
                                  "instituto geográfico", "instituto geografico", "ign ",
                                  "instituto de calidad", "inacal", "bomberos",
                                  "intendencia nacional", "autoridad nacional de infraestructura",
                                  "superintendencia"]),
    Rule("Programas Sociales", ["inabif", "qali warma", "cuna más", "cuna mas",
                                "pensión 65", "pension 65", "juntos", "agrorural",
                                "agro rural", "agroideas", "agromercado", "fonafe",
                                "fondoempleo", "biblioteca nacional", "ipd ",
                                "instituto peruano del deporte", "proyecto nay", "naylamp",
                                "proyecto especial", "midis", "llamkasun",
                                "programa nacional", "programa conservación", "programa conservacion",
                                "dirección de agricultura", "direccion de agricultura"]),
    Rule("Gobiernos Regionales", ["gobierno regional", "gore ", "gore-", "región "]),
    Rule("Municipalidades", ["municipalidad", "municipio"]),
    Rule("Ministerios", ["ministerio", "mininter", "mindef", "mimp",
                         "minagri", "midagri", "minam", "mincetur",
                         "minem", "produce", "mtc ", "mtc-", "mvcs",
                         "provias"]),
), default="Otros", mode="folded", exact={
    "sis": "Salud / Hospitales", "ipd": "Programas Sociales",
    "ign": "Sup. y Fiscalización", "inei": "Sup. y Fiscalización",
    "inacal": "Sup. y Fiscalización", "inictel-uni": "Educación",
    "cenepred": "Sup. y Fiscalización", "sbn": "Sup. y Fiscalización",
    "agro rural": "Programas Sociales",
})
INSTITUTION_GRID_ORDER = ["Ministerios", "Gobiernos Regionales", "Salud / Hospitales",
                          "Justicia", "Educación", "Municipalidades",
                          "Programas Sociales", "Sup. y Fiscalización", "Identidad / Civil"]
INSTITUTION_TREE_ORDER = ["Educación", "Gobiernos Regionales", "Ministerios",
                          "Sup. y Fiscalización", "Identidad / Civil", "Otros",
                          "Salud / Hospitales", "Municipalidades", "Justicia",
                          "Programas Sociales"]

# R25 departments, alphabetical; first substring hit wins ('ICA' also hits
# 'REPUBLICA' -- kept as the study does it).
DEPARTMENTS = ["AMAZONAS", "ANCASH", "APURIMAC", "AREQUIPA", "AYACUCHO",
               "CAJAMARCA", "CALLAO", "CUSCO", "HUANCAVELICA", "HUANUCO",
               "ICA", "JUNIN", "LA LIBERTAD", "LAMBAYEQUE", "LIMA",
               "LORETO", "MADRE DE DIOS", "MOQUEGUA", "PASCO", "PIURA",
               "PUNO", "SAN MARTIN", "TACNA", "TUMBES", "UCAYALI"]

# R26 company-size bins (right-closed).
SIZE_EDGES = [0, 2, 5, 10, float("inf")]
SIZE_LABELS = ["Pequeña", "Mediana", "Grande", "Corporativa"]

# R27 monthly income bands (lower edge inclusive).
INCOME_BANDS = [
    ("A++", 30000.0, None), ("A+", 15000.0, 30000.0), ("A", 8000.0, 15000.0),
    ("B", 4500.0, 8000.0), ("C", 2500.0, 4500.0), ("D", 1500.0, 2500.0), ("E", None, 1500.0),
]

# R28 payroll record-state predicates.
ACTIVE_STATE = "OCUPADO"
ACTIVE_TYPES = ["Activos", "Contrato Administrativo de Servicios"]

# R29 "looks like a pay page".
PAY_PAGE_WORDS = ["salario", "S/", "puesto"]
PAY_PAGE_PASS_RATE = 0.60

# C8 salary rescue: which titles are trainees, which are professionals.
TRAINEE_HINT = "practicante|trainee|intern|auxiliar|asistente|assistant"
PROFESSIONAL_HINT = ("analista|analyst|coordinador|coordinator|especialista|specialist|ejecutivo|executive|"
                     "asesor|advisor|supervisor|jefe|head|gerente|manager")
