"""Word lists, patterns, formats and default weights that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

# Timestamp formats in the order they are tried; digits may lack leading zeros, parts in brackets may be missing.
TIMESTAMP_FORMATS = ("d.M.yyyy[ H:m[:s]]", "yyyy-M-d[ H:m:s]", "d/M/yyyy[ H:m:s]", "M/d/yyyy[ H:m:s]")
ISO_FORMATS = ("yyyy-MM-dd['T'][' ']HH:mm:ss[.SSSSSS][.SSS][XXX]",)
UNIX_LEAST = 1_000_000_000

# Error codes.
CODE = r"^(?:[CJEF]\d{3,5}|S\d{3,5}|SC\d{3,4}|\d{2}-\d{3}-\d{2})$"
DASHED_CODE = r"(?U)\b\d{2}-\d{3}-\d{2}\b"
CODE_PREFIX = r"(?iu)^(?:error|err|код|ошибка|code)[\s:_\-]*"
CODE_PATTERNS = {
    "kyocera": (r"[CJEF]\d{4,5}", r"SC\d{3}"),
    "hp": (r"\d{2}\.\d{2}\.\d{2}", r"\d{2}\.\d{1,2}"),
    "ricoh": (r"SC\d{3}", r"[CJEF]\d{4}"),
    "xerox": (r"\d{2}-\d{3}-\d{2}", r"\d{3}-\d{3}", r"\d{3}\.\d{3}\.\d{3}"),
    "canon": (r"E\d{3}-\d{4}", r"[CJEF]\d{4}"),
    "brother": (r"[A-Z]{2}\d{2}",),
    "generic": (r"[CJEFS]\d{3,5}", r"SC\d{3}", r"ERR[-_]?\d{3,5}", r"\d{2}-\d{3}-\d{2}"),
}

# Column names that mean a field, in normalised form.
SYNONYMS = {
    "device_id": (
        "device_id deviceid device-id dev_id devid id device serial serial_number serialnumber device_serial device_sn printer_id prn_id id_printer mfp_id id_mfp "
        "host_name hostname host id_устройства идентификатор серийный_номер серийный инв_номер инвентарный номер_мфу номер"
    ).split(),
    "timestamp": "timestamp ts time datetime event_time eventtime created_at createdat дата время дата_время дата_события дата_и_время clock".split(),
    "error_code": "error_code errorcode error code err error_id errorid код_ошибки код ошибка event_code".split(),
    "error_description": "error_description description error_text message metric_value описание описание_ошибки текст_ошибки сообщение".split(),
    "model": "model device_model printer_model host_display_name display_name модель модель_устройства".split(),
    "vendor": "vendor manufacturer brand производитель бренд вендор".split(),
    "location": "location site office building room локация офис адрес местоположение".split(),
    "status": "status device_status state статус состояние".split(),
    "mileage": "mileage page_count pages counter total_pages пробег счётчик страниц_напечатано".split(),
    "toner_level": "toner_level toner toner_pct toner_% toner_remaining тонер уровень_тонера".split(),
    "drum_level": "drum_level drum drum_pct drum_remaining барабан ресурс_барабана".split(),
    "fuser_level": "fuser_level fuser fuser_pct fuser_remaining фьюзер ресурс_фьюзера".split(),
}
LEVEL_HINTS = {"toner_level": ("toner", "тонер"), "drum_level": ("drum", "барабан"), "fuser_level": ("fuser", "фьюзер")}
MILEAGE_HINTS = ("count", "pages", "pagecount", "пробег", "счетчик", "страниц")

# Words that mark a leading SQL line of an export.
PREAMBLE_WORDS = ("SELECT", "UNION", "FROM", "WHERE", "INNER", "LEFT", "RIGHT", "JOIN", "INSERT", "UPDATE", "CREATE", "WITH")

# Keys and columns of metric-per-row exports.
LEVEL_KEYS = ("SupplLev", "prtMarkerSuppliesLevel")
MAX_KEYS = ("SupplMax", "prtMarkerSuppliesMaxCapacity")
SUPPLIES = {"toner": ("toner",), "drum": ("drum", "print cartridge", "принт-картридж", "барабан"), "fuser": ("fuser", "фьюзер")}
ERROR_KEYS = ("errdisp", "errorondisplay")
NO_VALUE = ("nan", "none", "null", "na", "")
VALUE_COLUMNS = ("metric_value", "value")
DEVICE_COLUMNS = ("id_prn", "hostid", "host_name", "host")
CLOCK_COLUMNS = ("clock", "clock_time", "timestamp", "ts")

# Severities, the order vendors are asked in, prefixes that slugs drop.
SEVERITIES = ("Critical", "High", "Medium", "Low", "Info")
SEVERITY_WORDS = {"critical": "Critical", "high": "High", "medium": "Medium", "low": "Low", "info": "Info", "major": "High", "minor": "Low", "warning": "Medium"}
SLUG_PREFIXES = ("xerox ", "lexmark ", "ricoh ", "kyocera ", "hp ", "canon ")

# Components and their names in documents.
COMPONENTS = {
    "fuser": ("фьюзер", "печка", "термоблок", "fusing unit", "fuser unit", "heat roller", "нагревательный ролик", "термопленка"),
    "drum": ("барабан", "фотобарабан", "OPC drum", "photoconductor", "imaging unit", "drum unit", "фотоцилиндр"),
    "toner": ("тонер", "тонер-картридж", "toner cartridge", "toner bottle", "тонер-бутылка"),
    "developer": ("девелопер", "проявитель", "developer unit", "developing unit"),
    "scanner": ("сканер", "scanner unit", "CIS", "CCD", "scanner glass", "стекло сканера", "ADF", "автоподатчик"),
    "laser_unit": ("лазерный блок", "laser unit", "LSU", "laser scanner unit", "оптический блок"),
    "transfer": ("трансферный блок", "transfer belt", "transfer roller", "ремень переноса", "ролик переноса", "ITB"),
    "fan": ("вентилятор", "fan motor", "cooling fan", "кулер"),
    "paper_feed": ("подача бумаги", "paper feed", "feed roller", "ролик подачи", "pickup roller", "ролик захвата", "лоток", "cassette", "tray"),
    "duplex": ("дуплекс", "duplex unit", "двусторонняя печать"),
    "network": ("сеть", "network board", "LAN", "Wi-Fi", "сетевой модуль"),
    "controller": ("контроллер", "main board", "engine board", "материнская плата", "PWB"),
    "power_supply": ("блок питания", "power supply", "PSU", "power unit"),
}

# Personal data in documents, and what every match holds. An address begins where its run of characters does,
# or behind the match before, and is tried from there only: otherwise a run of n characters without @ takes n * n steps.
PERSONAL = (
    (r"\+7\s*\(?\d{3}\)?\s*\d{3}[- ]?\d{2}[- ]?\d{2}", "[PHONE]", "+7"),
    (r"(?U)(?:(?<![\w.+-])|\G)[\w.+-]++@[\w-]++\.[\w.-]+", "[EMAIL]", "@"),
)


@dataclass(frozen=True)
class Modifier:
    """A context rule: which resource against which bound, for which components (``*``: any)."""

    name: str
    resource: str
    threshold: float | None
    multiplier: float
    components: tuple[str, ...]


@dataclass(frozen=True)
class Weights:
    """A scoring profile; the defaults are fixed values."""

    name: str = "default"
    severity: dict[str, float] = field(default_factory=lambda: {"Critical": 60.0, "High": 20.0, "Medium": 10.0, "Low": 3.0, "Info": 0.0})
    repeat_base: float = 2.0
    repeat_max: float = 5.0
    repeat_days: int = 14
    context_max: float = 1.5
    age_tau: float = 14.0
    window_days: int = 30
    confidence_min: float = 0.2
    rag_not_found: float = 0.7
    missing_resources: float = 0.85
    missing_model: float = 0.6
    abnormal_daily_jump: float = 0.8
    anomalous_event_count: float = 0.7
    no_events_and_no_resources: float = 0.9
    green: int = 75
    red: int = 40
    critical_per_day: int = 1
    silent_mode: str = "data_quality"
    modifiers: tuple[Modifier, ...] = (
        Modifier("toner_low", "toner_level", 10.0, 1.5, ("print", "quality")),
        Modifier("drum_high", "drum_level", 90.0, 1.3, ("quality",)),
        Modifier("fuser_high", "fuser_level", 90.0, 1.5, ("fusing", "jam")),
        Modifier("mileage_over_interval", "mileage", None, 1.2, ("*",)),
    )
