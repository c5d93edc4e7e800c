"""The manifest of a run: which member has which role, and documents about the run."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..functions.columns import COMPONENTS

# The format's names.
MANIFEST, ARCHIVE_SUFFIX = "mzpeak_index.json", ".mzpeak"
SPECTRA, SIGNALS, PEAKS = ("spectrum", "metadata"), ("spectrum", "data arrays"), ("spectrum", "peaks")
CHROMATOGRAMS, CHROMATOGRAM_SIGNALS = ("chromatogram", "metadata"), ("chromatogram", "data arrays")
WAVELENGTHS, WAVELENGTH_SIGNALS = ("wavelength spectrum", "metadata"), ("wavelength spectrum", "data arrays")
DOCUMENTS = ("file_description", "instrument_configuration_list", "software_list", "data_processing_method_list", "sample_list", "run")
VERSION = "mzpeak-0.9"
VOCABULARIES = (
    {"id": "MS", "full_name": "PSI-MS controlled vocabulary", "uri": "https://raw.githubusercontent.com/HUPO-PSI/psi-ms-CV/master/psi-ms.obo", "version": "4.1.x"},
    {"id": "IMS", "full_name": "Mass Spectrometry Imaging controlled vocabulary", "uri": "https://raw.githubusercontent.com/imzML/imzML/master/imagingMS.obo", "version": "1.1.x"},
    {"id": "UO", "full_name": "Unit Ontology", "uri": "https://raw.githubusercontent.com/bio-ontology-research-group/unit-ontology/master/unit.obo", "version": "2024-01-01"},
)


class RunError(ValueError):
    """A run that can't be read or written as asked."""


@dataclass
class Manifest:
    files: list[dict]
    metadata: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Manifest:
        try:
            doc = json.loads(text)
        except json.JSONDecodeError as e:
            raise RunError(f"the manifest is no JSON: {e}") from e
        if not isinstance(doc, dict) or not isinstance(doc.get("files"), list):
            raise RunError("the manifest has no list of files")
        return cls([f for f in doc["files"] if isinstance(f, dict)], doc["metadata"] if isinstance(doc.get("metadata"), dict) else {})

    def find(self, role: tuple[str, str]) -> str | None:
        """The member of a role, (entity type, data kind): by role and never by name; the first if several have it."""
        return next((f.get("name") for f in self.files if (f.get("entity_type"), f.get("data_kind")) == role), None)

    @property
    def version(self) -> str | None:
        return self.metadata.get("version")

    @property
    def vocabularies(self) -> list[dict]:
        return _items(self.metadata.get("cv_list"))

    @property
    def scan_settings(self) -> list[dict]:
        """[{id, parameters}]; values that are text are read as whole numbers or numbers if they are such."""
        return [{"id": _text(s, "id"), "parameters": [parameter(p, "unit_accession", numbers=True) for p in _items(s.get("parameters"))]} for s in _items(self.metadata.get("scan_settings_list"))]

    @property
    def is_imaging(self) -> bool:
        flag = self.metadata.get("imaging")
        return bool(isinstance(flag, dict) and flag.get("is_imaging") is True) or bool(self.scan_settings)


def _items(x) -> list[dict]:
    return [i for i in x if isinstance(i, dict)] if isinstance(x, list) else []


def _text(x: dict, key: str) -> str | None:
    v = x.get(key)
    return v if v is None or isinstance(v, str) else json.dumps(v)


def _int(x: dict, key: str, default: int | None = 0) -> int | None:
    v = x.get(key)
    return int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else default


def parameter(p: dict, unit: str = "unit", numbers: bool = False) -> dict:
    """A parameter as name, accession, value (one arm of four set) and unit."""
    v = p.get("value")
    if numbers and isinstance(v, str):
        for kind in (int, float):
            try:
                v = kind(v)
                break
            except ValueError:
                continue
    arms = {"integer": None, "float": None, "string": None, "boolean": None}
    if isinstance(v, bool):
        arms["boolean"] = v
    elif isinstance(v, int):
        arms["integer"] = v
    elif isinstance(v, float):
        arms["float"] = v
    elif v is not None:
        arms["string"] = v if isinstance(v, str) else json.dumps(v)
    return {"name": _text(p, "name"), "accession": _text(p, "accession"), "value": arms, "unit": _text(p, unit)}


def _document(footer: dict[str, str], key: str):
    text = footer.get(key)
    if text is None or not text.strip():
        return None
    try:
        return json.loads(text)
    except json.JSONDecodeError as e:
        raise RunError(f"footer document {key} is no JSON") from e


def _params(x: dict, key: str = "parameters") -> list[dict]:
    return [parameter(p) for p in _items(x.get(key))]


def _component(name: str | None) -> str:
    return next((kind for kind, names in COMPONENTS.items() if (name or "").lower() in names), "UNKNOWN")


def file_metadata(footer: dict[str, str]) -> dict:
    """The six footer documents in one shape: what is absent is None or empty, what isn't a list where one belongs is empty."""
    about, run = _document(footer, "file_description"), _document(footer, "run")
    return {
        "file_description": None if not isinstance(about, dict) else {"contents": _params(about, "contents"), "source_files": [{"id": _text(s, "id"), "name": _text(s, "name"), "location": _text(s, "location"), "parameters": _params(s)} for s in _items(about.get("source_files"))]},
        "instrument_configuration_list": [
            {"id": _int(c, "id"), "software_reference": _text(c, "software_reference"), "parameters": _params(c), "components": [{"component_type": _component(_text(p, "component_type")), "order": _int(p, "order"), "parameters": _params(p)} for p in _items(c.get("components"))]}
            for c in _items(_document(footer, "instrument_configuration_list"))
        ],
        "software_list": [{"id": _text(s, "id"), "version": _text(s, "version"), "parameters": _params(s)} for s in _items(_document(footer, "software_list"))],
        "data_processing_method_list": [{"id": _text(m, "id"), "methods": [{"order": _int(p, "order"), "software_reference": _text(p, "software_reference"), "parameters": _params(p)} for p in _items(m.get("methods"))]} for m in _items(_document(footer, "data_processing_method_list"))],
        "sample_list": [{"id": _text(s, "id"), "name": _text(s, "name"), "parameters": _params(s)} for s in _items(_document(footer, "sample_list"))],
        "run": None if not isinstance(run, dict) else {"id": _text(run, "id"), "default_instrument_id": _int(run, "default_instrument_id", None), "default_data_processing_id": _text(run, "default_data_processing_id"), "default_source_file_id": _text(run, "default_source_file_id"), "start_time": _text(run, "start_time"), "parameters": _params(run)},
    }


def read_text(spark: SparkSession, path: str) -> str:
    """A small file in any store that Spark reads."""
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    return rows[0][0] if rows else ""
