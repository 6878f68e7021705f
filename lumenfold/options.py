"""Run options: what the command line offers, plus the choices that its quirks need."""

from __future__ import annotations

from dataclasses import dataclass

SHORTCUT, DUPLICATE_COPY, JSON, NOTHING = "shortcut", "duplicate-copy", "json", "nothing"
ALBUM_MODES = (SHORTCUT, DUPLICATE_COPY, JSON, NOTHING)

#: Files above this size aren't read: 64 MiB.
MAX_READ_BYTES = 64 * 1024 * 1024

# Name endings of edited copies, lower case, in order of precedence.
EXTRA_SUFFIXES = (
    "-edited",
    "-effects",
    "-smile",
    "-mix",
    "-edytowane",
    "-bearbeitet",
    "-bewerkt",
    "-編集済み",
    "-modificato",
    "-modifié",
    "-ha editado",
    "-editat",
)

#: Centuries of the years that dates in names have.
NAME_CENTURIES = ("20", "19", "18")


@dataclass(frozen=True)
class Options:
    """``oversize_policy``: "reference" treats equal-sized files above MAX_READ_BYTES as equal, "full_hash" reads them."""

    input: str = ""
    output: str = ""
    albums: str = SHORTCUT
    divide_to_dates: bool = False
    skip_extras: bool = False
    guess_from_name: bool = True
    copy: bool = False
    timezone: str = "UTC"
    oversize_policy: str = "reference"
    reject_zero_exif: bool = True
    on_nonempty_output: str = "fail"
    extra_suffixes: tuple[str, ...] = EXTRA_SUFFIXES
    name_centuries: tuple[str, ...] = NAME_CENTURIES

    def __post_init__(self) -> None:
        for value, known in ((self.albums, ALBUM_MODES), (self.oversize_policy, ("reference", "full_hash")), (self.on_nonempty_output, ("fail", "clean", "append"))):
            if value not in known:
                raise ValueError(f"{value!r} is none of {known}")
