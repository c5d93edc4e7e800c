"""Where the members of a run are: a folder, or a ZIP archive whose members are read in place, or staged if they are compressed."""

from __future__ import annotations

import os
import posixpath
import shutil
import struct
import uuid
import zipfile
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .groups import Member
from .manifest import MANIFEST, RunError, read_text
from .storage import shared_dir


def safe_member(name: str) -> str:
    """The name, if it stays inside the run."""
    clean = posixpath.normpath(name.replace("\\", "/"))
    if not name or clean.startswith(("/", "../")) or clean == ".." or ":" in clean.split("/")[0]:
        raise RunError(f"member {name!r} lies outside the run")
    return clean


def checked_members(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """The files of an archive; duplicates, unsafe names, sizes that don't fit and methods other than STORED and DEFLATED are errors."""
    found: dict[str, zipfile.ZipInfo] = {}
    for m in archive.infolist():
        if m.is_dir():
            continue
        name = safe_member(m.filename)
        if name in found:
            raise RunError(f"the archive has member {name!r} twice")
        if m.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise RunError(f"member {name!r} is compressed in a way that isn't supported")
        if m.compress_type == zipfile.ZIP_STORED and m.compress_size != m.file_size:
            raise RunError(f"stored member {name!r} has two sizes")
        found[name] = m
    return list(found.values())


def staged(spark: SparkSession, path: str) -> str:
    """The members of a local ZIP archive, copied to a folder of their own in the shared folder; Spark can't read inside archives.

    Copied block by block, so that no member is ever held whole; the CRC of each is checked on the way.
    """
    root = shared_dir(spark)
    if "://" in root and not root.startswith("file:"):
        raise RunError("archives are staged through a folder that the driver can write to as files")
    local = root.removeprefix("file://").removeprefix("file:")
    target = os.path.join(local, f"ionloom-run-{uuid.uuid4().hex}")
    try:
        with zipfile.ZipFile(path) as archive:
            for m in checked_members(archive):
                out = os.path.join(target, safe_member(m.filename))
                os.makedirs(os.path.dirname(out), exist_ok=True)
                with archive.open(m) as a, open(out, "wb") as b:
                    shutil.copyfileobj(a, b, 1 << 20)
    except (zipfile.BadZipFile, OSError) as e:
        shutil.rmtree(target, ignore_errors=True)
        raise RunError(f"{path} is no archive that can be read: {e}") from e
    except RunError:
        shutil.rmtree(target, ignore_errors=True)
        raise
    return f"file://{target}"


#: Fixed values of ZIP: the mark and length of a member's local header, and where its name's and extra field's lengths are.
LOCAL_MARK, LOCAL_SIZE, LOCAL_LENGTHS = b"PK\x03\x04", 30, 26


def stored_members(path: str) -> dict[str, Member] | None:
    """The members' places inside an archive, or None if some besides the manifest are compressed. Reads headers only."""
    try:
        with zipfile.ZipFile(path) as archive, open(path, "rb") as raw:
            found, size = {}, os.path.getsize(path)
            for m in checked_members(archive):
                if m.compress_type != zipfile.ZIP_STORED:
                    if safe_member(m.filename) == MANIFEST:
                        continue
                    return None
                raw.seek(m.header_offset)
                header = raw.read(LOCAL_SIZE)
                if len(header) < LOCAL_SIZE or header[:4] != LOCAL_MARK:
                    raise RunError(f"member {m.filename!r} has no header where the archive says")
                start = m.header_offset + LOCAL_SIZE + sum(struct.unpack_from("<HH", header, LOCAL_LENGTHS))
                if start + m.file_size > size:
                    raise RunError(f"member {m.filename!r} ends behind the archive")
                found[safe_member(m.filename)] = Member(os.path.abspath(path), start, m.file_size)
            return found
    except (zipfile.BadZipFile, OSError) as e:
        raise RunError(f"{path} is no archive that can be read: {e}") from e


@dataclass
class Place:
    """Where a run's members are: files of a folder, or parts of an archive."""

    folder: str
    members: dict[str, Member] = field(default_factory=dict)
    manifest: str | None = None
    staged: bool = False

    def manifest_text(self, spark: SparkSession) -> str:
        return self.manifest if self.manifest is not None else read_text(spark, f"{self.folder}/{MANIFEST}")

    def direct(self, name: str) -> Member | None:
        """The member as a file that tasks can open by themselves; None in a store that only Spark reads, or if it has several part files."""
        if name in self.members:
            return self.members[name]
        path = os.path.join(self.folder.removeprefix("file://"), name)
        return Member(path) if self.folder.startswith("file://") and os.path.isfile(path) else None

    def remove(self) -> None:
        if self.staged:
            shutil.rmtree(self.folder.removeprefix("file://"), ignore_errors=True)


def located(spark: SparkSession, path: str) -> Place:
    """Where a run's members are. A path with a scheme is a folder in that store.

    STORED members of an archive are read where they are, so that executors need to see the archive, too; an archive with
    compressed members is staged.
    """
    if "://" in path:
        return Place(path.rstrip("/"))
    if os.path.isdir(path):
        if not os.path.exists(os.path.join(path, MANIFEST)):
            raise RunError(f"{path} has no {MANIFEST}")
        return Place(f"file://{os.path.abspath(path)}")
    if not os.path.isfile(path):
        raise RunError(f"{path} is neither a folder nor a file")
    members = stored_members(path)
    with zipfile.ZipFile(path) as archive:
        names = {safe_member(m.filename): m for m in archive.infolist() if not m.is_dir()}
        if MANIFEST not in names:
            raise RunError(f"{path} has no {MANIFEST}")
        text = archive.read(names[MANIFEST]).decode("utf-8")
    return Place(staged(spark, path), staged=True) if members is None else Place("", members, text)


def pack(folder: str, archive: str) -> None:
    """A folder's files, by name, as STORED members of an archive that appears under its name only when it is whole."""
    part = f"{archive}.{uuid.uuid4().hex}.part"
    try:
        with zipfile.ZipFile(part, "w", zipfile.ZIP_STORED) as out:
            for name in sorted(n for n in os.listdir(folder) if not n.startswith(".")):  # checksums of the file system
                out.write(os.path.join(folder, name), name)
        os.replace(part, archive)
    finally:
        if os.path.exists(part):
            os.remove(part)
