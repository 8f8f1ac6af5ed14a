"""Words, headings and limits that results depend on."""

# Headings and texts shown in results.
TOTAL = "Total"
NO_DATA = "Sin dato"
OUT_OF_BANDS = "(Sin dato o fuera de rango)"
PROMOTER = "Promotor"
PASSIVE = "Pasivo"
DETRACTOR = "Detractor"

# Texts that count as no open-ended answer.
NO_RESPONSE_TEXTS = (
    "", "nan", "none", "null", "na", "n/a", "no aplica", "no se", "no sé",
    "ninguno", "ninguna",
)

# A label containing one of these is an exclusive option.
EXCLUSIVE_OPTION_HINTS = (
    "ninguna", "ninguno", "no aplica", "no recuerdo", "no recuerda",
    "no hubo mensajes", "no sabe", "no contesta",
)

# Names that mark an identifier column, in search order.
ID_NAMES = ("id", "folio", "respondent_id", "idgd", "record", "entrevista", "serial")

# Normalised words that mean yes.
YES_WORDS = (
    "1", "si", "s", "yes", "y", "true", "verdadero", "x", "usar", "incluir",
    "incluido", "recomendado", "recomendada", "dashboard", "aplica",
)

# Words that mark a selected multiple-response cell.
SELECTED_WORDS = ("si", "yes", "seleccionado", "selected")

# Lower-case texts that are not valid banner or filter values.
INVALID_TEXTS = ("", "nan", "none", "null", "na", "n/a")

# Texts that count as an empty codebook cell.
EMPTY_CELLS = ("", "nan", "none")

# Words of a variable's name or label that mark a weight.
WEIGHT_WORDS = ("pond", "ponder", "peso", "weight", "wgt", "factor")

# Words that mark an identifier of a case.
ID_WORDS = ("id", "folio", "case", "record", "respondent", "respondiente", "entrevista")

# Words that mark a control variable.
CONTROL_WORDS = (
    "sys", "system", "rotation", "rotacion", "rotación", "cell", "celda", "key", "clave",
    "product", "producto", "lot", "lote", "classification", "clasificacion", "clasificación",
    "quota", "cuota", "sample", "muestra", "usuario",
)

# Parts of a name, in capitals, that make a variable a weight.
WEIGHT_NAME_PARTS = ("POND", "PONDERADOR", "WEIGHT", "FACTOR_EXPANSION", "PESO")

# Parts of a class, in normal form, that make a variable a weight.
WEIGHT_CLASS_PARTS = ("ponderador", "peso", "weight")

# Fixed value: the form of a variable name; dots are legal inside it.
VARIABLE_PATTERN = r"[A-Za-z@#$][A-Za-z0-9_@#$]*(?:\.[A-Za-z0-9_@#$]+)*"

# Fixed value: the form of one `code: count` entry of a base distribution.
COUNT_ENTRY = r"(-?[0-9]+(?:\.[0-9]+)?)\s*:\s*([0-9,]+)"

# Fixed value: the form of a variable name without separators, prefix with number and item.
SHORT_NAME = r"^([A-Za-z]+[0-9]+)_?([0-9]+|[A-Za-z])$"

# Parts of a label, in lower case, that mark the iterations of a loop.
LOOP_LABELS = ("looplabel", "looptime")

# Fixed value: where an entry of a base distribution begins inside a text.
ENTRY_START = r"(?:^|;|\s)"

# Parts of a question type, in normal form, and the calculation each implies.
MULTI_TYPE_PARTS = ("rm", "multiple")
MEAN_TYPE_PARTS = ("escala", "grid", "numerica")
NPS_TYPE_PART = "nps"

# Parts of a grid's texts, in normal form, that say which kind it is.
GRID_PARTS = ("grid", "loop")
GRID_MULTI_PARTS = ("grid_rm", "loop_rm")
GRID_SCALE_PARTS = ("grid_escala", "grid escala")
LOOP_NUMBER_PARTS = ("loop_numerico", "loop numerico")
OPTION_PARTS = ("loop", "opcion")

# Parts of a question's texts, in lower case, that decide its inferred type.
ACCENTED_OPTION_PARTS = ("loop", "opcion", "opción")
ACCENTED_NUMBER_PARTS = ("loop_numerico", "loop_numérico")
SCALE_TEXT_PARTS = ("escala", "grid", "media", "top2box", "bottombox")
MULTI_TEXT_PARTS = ("multirrespuesta", "multiple", " rm")

# Categories up to which a variable is offered as a filter.
MAX_FILTER_CATEGORIES = 50
MIN_CANONICAL_BASE = 30
MIN_EXPECTED_COUNT = 5
