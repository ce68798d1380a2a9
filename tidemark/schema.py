"""Table schemas and fixed sets. All values here are fixed by the data's format."""

from __future__ import annotations

CAPTURE_COLUMNS = ("digest", "original_url", "timestamp", "mimetype", "statuscode", "size_bytes", "sha256", "store_path", "first_seen")
FAILURE_COLUMNS = ("original_url", "timestamp", "digest", "mimetype", "statuscode", "length", "reason")
INDEX_COLUMNS = ("original", "timestamp", "digest", "mimetype", "statuscode", "length")

DOCUMENT_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "rtf", "odt", "ods", "odp", "csv", "zip", "rar", "7z", "txt")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "tif", "tiff", "svg", "ico")
HTML_EXTENSIONS = ("html", "htm", "xhtml", "php", "asp", "aspx", "jsp", "shtml")
PHOTO_EXTENSIONS = ("jpg", "jpeg", "tif", "tiff")
METADATA_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx")
GZIP_EXTENSIONS = ("gz", "gzip", "tgz", "svgz")

MIME_EXTENSIONS = {
    "application/pdf": "pdf",
    "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.ms-excel": "xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.ms-powerpoint": "ppt",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/rtf": "rtf",
    "application/zip": "zip",
    "application/vnd.oasis.opendocument.text": "odt",
    "application/vnd.oasis.opendocument.spreadsheet": "ods",
    "application/vnd.oasis.opendocument.presentation": "odp",
    "image/jpeg": "jpg",
    "image/png": "png",
    "image/gif": "gif",
    "image/webp": "webp",
    "image/bmp": "bmp",
    "image/tiff": "tif",
    "image/svg+xml": "svg",
}

RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)))
PERMANENT_MARKER = "[PERMANENT]"
