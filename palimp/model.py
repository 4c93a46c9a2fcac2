"""Schemas, lookup tables and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

FINDING = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
])

# Severity order, worst first; anything else ranks after them.
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2, "info": 3}
UNKNOWN_RANK = 9

# Findings catalogue, id -> (category, severity, title).
FINDINGS = {
    "meta.docinfo": ("metadata", "low", "Document information"),
    "meta.xmp": ("metadata", "low", "Metadata packet"),
    "scripts.js": ("scripts", "high", "Embedded script"),
    "actions.launch": ("actions", "high", "Launches a program or file"),
    "actions.autorun": ("actions", "medium", "Runs without a click"),
    "actions.remote": ("actions", "medium", "Opens another document"),
    "forms.submit": ("forms", "high", "Sends form data"),
    "links.uri": ("links", "low", "External links"),
    "files.embedded": ("files", "high", "Embedded files"),
    "forms.acro": ("forms", "info", "Form fields"),
    "content.ocg": ("content", "low", "Hidden layers"),
    "content.invisible_text": ("content", "medium", "Invisible text"),
    "encryption.locked": ("encryption", "info", "Cannot be opened"),
    "clean": ("content", "info", "Nothing found"),
    "location.gps": ("location", "high", "Photo location embedded"),
    "metadata.camera": ("metadata", "medium", "Camera and capture details"),
    "content.thumbnail": ("content", "medium", "Embedded thumbnail"),
    "metadata.authorship": ("metadata", "low", "Author or copyright metadata"),
    "location.embedded_image": ("location", "high", "Location in an embedded image"),
    "metadata.embedded_image": ("metadata", "medium", "Metadata in an embedded image"),
}

# Sanitise switch -> (default, promised findings).
SANITIZE_SWITCHES = {
    "javascript": (True, ["scripts.js"]),
    "launch_actions": (True, ["actions.launch"]),
    "auto_actions": (True, ["actions.autorun"]),
    "embedded_files": (True, ["files.embedded"]),
    "submit_actions": (True, ["forms.submit"]),
    "external_links": (False, ["links.uri"]),
    "metadata": (False, ["meta.docinfo", "meta.xmp"]),
}

# Compression presets, 0 dpi = use the colour dpi.
# key, colour_dpi, gray_dpi, mono_dpi, jpeg_q, skip_below_px, strip_metadata
PRESETS = [
    ("screen", 72, 0, 150, 35, 64, True),
    ("ebook", 120, 0, 200, 55, 48, True),
    ("standard", 150, 0, 0, 65, 32, False),
    ("high", 200, 0, 0, 80, 24, False),
    ("prepress", 300, 0, 0, 90, 16, False),
]
PRESET_SCHEMA = ("preset string, colour_dpi bigint, gray_dpi bigint, mono_dpi bigint, jpeg_q bigint, "
                 "skip_below_px bigint, strip_metadata boolean")

# Supported languages, code -> name.
LANGUAGES = {
    "en": "English", "zh": "Chinese", "hi": "Hindi", "es": "Spanish", "ar": "Arabic", "fr": "French",
    "bn": "Bengali", "pt": "Portuguese", "ru": "Russian", "id": "Indonesian", "de": "German", "da": "Danish",
}

# Limits.
MAX_INPUT_BYTES = 2 * 1024 ** 3
MAX_IMAGE_PIXELS = 200_000_000
MAX_FINDING_ITEMS = 50
REDACTION_MARK = "█"
SCRUB_MARK = "[redacted]"
EMPTY_PAGE_TEXT = "[No extractable text on this page]"

# File magics in hex.
MAGICS = {"pdf": "255044462D", "jpeg": "FFD8FF", "png": "89504E470D0A1A0A", "epdf": "4550444600010000"}

# The nine verified surfaces, and those that belong to the document rather than a page.
SURFACES = ["page_text", "raw_content", "annotations", "form_fields", "links",
            "docinfo", "xmp", "bookmarks", "embedded_files"]
DOCUMENT_SURFACES = ["docinfo", "xmp", "bookmarks", "embedded_files"]

# Trigger and action wordings.
TRIGGERS = {
    "WC": "fires just before the document is closed",
    "WS": "fires just before the document is saved",
    "DS": "fires right after the document is saved",
    "WP": "fires just before the document is printed",
    "DP": "fires right after the document is printed",
    "O": "fires when the page is opened",
    "C": "fires when the page is closed",
    "E": "fires when the pointer enters the field",
    "X": "fires when the pointer leaves the field",
    "D": "fires on mouse-down in the field",
    "U": "fires on mouse-up in the field",
    "Fo": "fires when the field gains focus",
    "Bl": "fires when the field loses focus",
    "PO": "fires when the field's page opens",
    "PC": "fires when the field's page closes",
    "PV": "fires when the field's page becomes visible",
    "PI": "fires when the field's page becomes hidden",
    "K": "fires on each keystroke in the field",
    "F": "fires when the field is formatted",
    "V": "fires when the field is validated",
    "Calc": "fires when field values are recalculated",
}
ACTION_VERBS = {
    "JavaScript": "runs embedded JavaScript",
    "Launch": "launches an external program or file",
    "URI": "opens a URL",
    "GoToR": "opens an external document",
    "GoToE": "opens an embedded document",
    "SubmitForm": "submits form data over the network",
    "ImportData": "imports data from another file",
    "Named": "runs a named viewer command",
    "Rendition": "plays embedded media",
    "Sound": "plays an embedded sound",
    "Movie": "plays an embedded movie",
}

# Image tags by privacy category.
AUTHORSHIP_TAGS = ["Artist", "Copyright", "XPAuthor", "XPComment", "ImageDescription"]
CAMERA_TAGS = ["Make", "Model", "DateTimeOriginal", "DateTime", "Software"]
THUMBNAIL_TAGS = ["513", "514"]
