"""Table and command schemas, enum labels and their sort ordinals."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The enum labels of the data model, in declaration order. The
# declaration order is the sort order of each enum. Labels are data values and
# stay as they are.
# ---------------------------------------------------------------------------
UNITS = ("PEZZI", "KG", "LITRI", "GRAMMI")
CATEGORIES = ("LATTICINI", "VERDURE", "FRUTTA", "CARNE", "PESCE", "CONSERVE", "BEVANDE", "ALTRO")
LOCATIONS = ("FRIGO", "FREEZER", "DISPENSA", "CANTINA")
PRIORITIES = ("ALTA", "MEDIA", "BASSA")
STATUSES = ("DA_FARE", "IN_CORSO", "COMPLETATO", "ANNULLATO")
FREQUENCIES = ("GIORNALIERA", "SETTIMANALE", "MENSILE")
REASONS = ("CONSUMATO", "SCADUTO", "BUTTATO")

# Derived labels and defaults.
STOCK_EXPIRED = "SCADUTO"
STOCK_EXPIRING = "IN_SCADENZA"
TASK_OVERDUE = "SCADUTO"
TASK_DUE_SOON = "SCADENZA_IMMINENTE"
BAND_EXPIRED = "CRITICA_SCADUTO"
BAND_TODAY = "ALTA_SCADE_OGGI"
BAND_TOMORROW = "ALTA_SCADE_DOMANI"
BAND_LATER = "MEDIA"
UNASSIGNED = "NON_ASSEGNATO"
TOTAL_GROUP = "TOTALE"
DEFAULT_PRIORITY = "MEDIA"
DEFAULT_STATUS = "DA_FARE"
DEFAULT_REASON = "CONSUMATO"
COMPLETED = "COMPLETATO"
CANCELLED = "ANNULLATO"
SEARCH_ID_PREFIX = "alimento-"
# Days added to a due date when a recurring task respawns.
RESPAWN_DAYS = {"GIORNALIERA": 1, "SETTIMANALE": 7, "MENSILE": 30}

# Audit operation types and table names.
OP_INSERT_ITEM = "INSERIMENTO_ALIMENTO"
OP_CONSUME_ITEM = "SCARICO_ALIMENTO"
OP_UPDATE_ITEM = "AGGIORNAMENTO_ALIMENTO"
OP_INSERT_TASK = "INSERIMENTO_TASK"
OP_COMPLETE_TASK = "COMPLETAMENTO_TASK"
OP_UPDATE_TASK = "AGGIORNAMENTO_TASK"
OP_CANCEL_TASK = "CANCELLAZIONE_TASK"
TABLE_ITEMS = "alimenti"
TABLE_TASKS = "task"

# Maximum text lengths of the stored columns.
MAX_LEN = {
    "name": 255,
    "supplier": 255,
    "lot": 100,
    "updated_by": 100,
    "title": 500,
    "assignee": 100,
    "created_by": 100,
}

# Default page sizes of the list and search reads.
DEFAULT_LIMIT = 50
SEARCH_LIMIT = 10

QTY = T.DecimalType(10, 3)
PRICE = T.DecimalType(10, 2)


def _f(name: str, dtype: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, dtype, nullable)


INVENTORY = T.StructType([
    _f("item_id", T.LongType(), False),
    _f("name", T.StringType(), False),
    _f("quantity", QTY, False),
    _f("unit", T.StringType(), False),
    _f("expiry_date", T.DateType()),
    _f("opened_date", T.DateType()),
    _f("category", T.StringType(), False),
    _f("location", T.StringType(), False),
    _f("price", PRICE),
    _f("supplier", T.StringType()),
    _f("lot", T.StringType()),
    _f("created_at", T.TimestampNTZType(), False),
    _f("updated_at", T.TimestampNTZType(), False),
    _f("updated_by", T.StringType(), False),
])

TASK = T.StructType([
    _f("task_id", T.LongType(), False),
    _f("title", T.StringType(), False),
    _f("description", T.StringType()),
    _f("priority", T.StringType(), False),
    _f("status", T.StringType(), False),
    _f("due_date", T.DateType()),
    _f("assignee", T.StringType()),
    _f("recurring", T.BooleanType(), False),
    _f("frequency", T.StringType()),
    _f("created_by", T.StringType(), False),
    _f("created_at", T.TimestampNTZType(), False),
    _f("updated_by", T.StringType(), False),
    _f("updated_at", T.TimestampNTZType(), False),
    _f("parent_task_id", T.LongType()),
])

CONSUMPTION = T.StructType([
    _f("consumption_id", T.LongType(), False),
    _f("item_id", T.LongType(), False),
    _f("qty", QTY, False),
    _f("consumed_at", T.TimestampNTZType(), False),
    _f("reason", T.StringType(), False),
    _f("note", T.StringType()),
])

AUDIT_LOG = T.StructType([
    _f("log_id", T.LongType(), False),
    _f("op_type", T.StringType(), False),
    _f("table_name", T.StringType(), False),
    _f("record_id", T.LongType(), False),
    _f("details", T.StringType()),
    _f("actor", T.StringType(), False),
    _f("ts", T.TimestampNTZType(), False),
])

TABLES = {
    "inventory": INVENTORY,
    "task": TASK,
    "consumption": CONSUMPTION,
    "audit_log": AUDIT_LOG,
}

# Command frames: one row per call. ``seq`` is the call order (unique, > 0, within
# a batch) and ``actor`` the caller. Numbers and dates of insert commands are text
# so that malformed input can be represented and rejected per row.
_CMD = [_f("seq", T.LongType(), False), _f("actor", T.StringType())]

INSERT_ITEM_CMD = T.StructType(_CMD + [
    _f("name", T.StringType()), _f("quantity", T.StringType()), _f("unit", T.StringType()),
    _f("category", T.StringType()), _f("location", T.StringType()),
    _f("expiry_date", T.StringType()), _f("opened_date", T.StringType()),
    _f("price", T.StringType()), _f("supplier", T.StringType()), _f("lot", T.StringType()),
])

CONSUME_CMD = T.StructType(_CMD + [
    _f("item_id", T.LongType()), _f("qty", QTY), _f("reason", T.StringType()),
    _f("note", T.StringType()), _f("force", T.BooleanType()),
])

DISCARD_CMD = T.StructType(_CMD + [
    _f("item_id", T.LongType()), _f("qty", QTY), _f("reason", T.StringType()),
    _f("note", T.StringType()),
])

UPDATE_ITEM_FIELDS = ("name", "quantity", "expiry_date", "opened_date", "category",
                      "location", "price", "supplier", "lot")
UPDATE_ITEM_CMD = T.StructType(_CMD + [
    _f("item_id", T.LongType()), _f("name", T.StringType()), _f("quantity", T.StringType()),
    _f("expiry_date", T.StringType()), _f("opened_date", T.StringType()),
    _f("category", T.StringType()), _f("location", T.StringType()),
    _f("price", T.StringType()), _f("supplier", T.StringType()), _f("lot", T.StringType()),
])

INSERT_TASK_CMD = T.StructType(_CMD + [
    _f("title", T.StringType()), _f("description", T.StringType()),
    _f("priority", T.StringType()), _f("due_date", T.StringType()),
    _f("assignee", T.StringType()), _f("recurring", T.BooleanType()),
    _f("frequency", T.StringType()),
])

UPDATE_TASK_FIELDS = ("title", "description", "priority", "status", "due_date", "assignee")
UPDATE_TASK_CMD = T.StructType(_CMD + [
    _f("task_id", T.LongType()), _f("title", T.StringType()), _f("description", T.StringType()),
    _f("priority", T.StringType()), _f("status", T.StringType()),
    _f("due_date", T.StringType()), _f("assignee", T.StringType()),
])

COMPLETE_TASK_CMD = T.StructType(_CMD + [_f("task_id", T.LongType()), _f("note", T.StringType())])
CANCEL_TASK_CMD = T.StructType(_CMD + [_f("task_id", T.LongType()), _f("reason", T.StringType())])

OUTCOME = T.StructType([
    _f("seq", T.LongType(), False),
    _f("key", T.LongType()),
    _f("ok", T.BooleanType(), False),
    _f("code", T.StringType(), False),
])
