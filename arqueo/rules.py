"""Rule tables of the domain. All of them are parameters of the operators that use them."""

# --- Fixed values: headers found in yearly files -> contract column ---
COLUMN_ALIASES = {
    "Region": "Región",
    "Cod Servicio": "Cod Serv Incorporado",
    "Nombre Servicio": "Nombre Serv Incorporado",
    "Cod Area": "Cod Subárea",
    "Nombre Area": "Nombre Subárea",
    "Cod Subarea": "Cod Subárea",
    "Nombre Subarea": "Nombre Subárea",
    "Cod Subtitulo": "Cod Subtítulo",
    "Nombre Subtitulo": "Nombre Subtítulo",
    "Cod Item": "Cod Ítem",
    "Nombre Item": "Nombre Ítem",
    "Cod Asignacion": "Cod Asignación",
    "Nombre Asignacion": "Nombre Asignación",
    "Cod Subasignacion": "Cod Subasignación",
    "Nombre Subasignacion": "Nombre Subasignación",
    "Cod Subsubasignacion": "Cod Subsubasignación",
    "Nombre Subsubasignacion": "Nombre Subsubasignación",
    "Ppto inicial": "Ppto Inicial",
    "Ppto actualizado": "Ppto Actualizado",
    "Devengado Acum": "Devengado Total",
    "Devengado acum": "Devengado Total",
    "Percibidopag Acum": "Percibidopag Total",
    "Percibidopag acum": "Percibidopag Total",
    "Porpercibir Acum": "Porpercibir Total",
    "Porpercibir acum": "Porpercibir Total",
    "Modif Ppto Enero": "Ppto Modif Enero",
    "Modif Ppto Febrero": "Ppto Modif Febrero",
    "Modif Ppto Marzo": "Ppto Modif Marzo",
    "Modif Ppto Abril": "Ppto Modif Abril",
    "Modif Ppto Mayo": "Ppto Modif Mayo",
    "Modif Ppto Junio": "Ppto Modif Junio",
    "Modif Ppto Julio": "Ppto Modif Julio",
    "Modif Ppto Agosto": "Ppto Modif Agosto",
    "Modif Ppto Septiembre": "Ppto Modif Septiembre",
    "Modif Ppto Octubre": "Ppto Modif Octubre",
    "Modif Ppto Noviembre": "Ppto Modif Noviembre",
    "Modif Ppto Diciembre": "Ppto Modif Diciembre",
}

# --- Fixed values: service key -> (code, name) ---
SERVICE_ALIASES = {
    "GESTIONMUNICIPAL": (1, "Gestión Municipal"),
    "EDUCACION": (2, "Educación"),
    "AREAEDUCACION": (2, "Educación"),
    "SALUD": (3, "Salud"),
    "AREASALUD": (3, "Salud"),
    "AREADESALUD": (3, "Salud"),
    "CEMENTERIO": (4, "Cementerios"),
    "CEMENTERIOS": (4, "Cementerios"),
    "AREACEMENTERIO": (4, "Cementerios"),
    "AREACEMENTERIOS": (4, "Cementerios"),
}

# --- Fixed values: account types, service names in scope, name aliases, label stop values ---
ACCOUNT_TYPES = {1: "INGRESOS", 2: "GASTOS"}
MUNICIPAL_SERVICE_NAMES = ("gestión municipal", "gestion municipal")
NAME_ALIASES = {
    "LLAYLLAY": "LLAILLAY",
    "MARCHIGUE": "MARCHIHUE",
    "PADREDELASCASAS": "PADRELASCASAS",
    "TREHUACO": "TREGUACO",
    "QIQUEN": "NIQUEN",
}
MEANINGLESS_NAMES = ("sin desagregacion", "nan", "none")

# --- Fixed values: (subtitle, sub-assignment) pairs of permanent own income ---
IPP_KEYS = (
    (3, 1001001),
    (3, 1002001),
    (3, 1002002),
    (3, 1002003),
    (3, 1003001),
    (3, 1003002),
    (3, 1003003),
    (3, 1003004),
    (3, 1003999),
    (3, 1004001),
    (3, 2001001),
    (3, 2002000),
    (3, 3000000),
    (5, 3007001),
    (6, 1000000),
    (6, 2000000),
    (6, 3000000),
    (6, 4000000),
    (6, 99000000),
    (8, 2001000),
    (8, 2001001),
    (8, 2001002),
    (8, 2001003),
    (8, 2001004),
    (8, 2001999),
    (8, 2003000),
    (8, 2005000),
    (8, 2008000),
    (13, 3005001),
    (13, 3005002),
)

# --- Fixed values: (subtitle, sub-assignment) pairs of the common municipal fund ---
FCM_KEYS = (
    (8, 3001000),
    (8, 3002000),
    (8, 3003001),
    (8, 3003002),
    (8, 3006001),
    (8, 3006002),
)

# --- Fixed values: text patterns over the accent-free upper-case account text ---
LEGACY_FCM_PATTERN = (
    r"FONDO COMUN MUNICIPAL|\bF\.?C\.?M\.\b|COMPENSACION LEY.*19[.]?850"
)
LEGACY_IPP_PATTERN = (
    r"IMPUESTO TERRITORIAL|PERMISOS? DE CIRCULACION|"
    r"PATENTES? MUNICIPALES|DERECHOS? DE ASEO|"
    r"DERECHOS? (?:VARIOS|MUNICIPALES)|LICENCIAS? DE CONDUCIR|"
    r"RENTA DE INVERSIONES|PATENTES? MINERAS|PATENTES? ACUICOLAS|"
    r"CASINOS? DE JUEGOS?|CONCESIONES?|MULTAS?(?: E| Y)? INTERESES|"
    r"JUZGADO(?: DE)? POLICIA LOCAL|MULTAS? LEY(?: DE)? ALCOHOLES"
)
LEGACY_CAPITAL_PATTERN = (
    r"GASTOS? DE CAPITAL|INVERSION|INFRAESTRUCT|CONSTRUCC|OBRAS?|"
    r"MEJORAMIENTO (?:DE )?BARRIOS|MEJORAMIENTO URBANO|"
    r"EQUIPAMIENTO|PAVIMENT|PMU|PMB"
)
# --- end of fixed values ---
