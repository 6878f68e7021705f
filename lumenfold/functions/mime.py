"""Media types by file name extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions whose media type starts with image/, and with video/; mts is model/vnd.mts.
IMAGE = "bmp btif cgm cmx djv djvu dng dwg dxf fbs fh fh4 fh5 fh7 fhc fpx fst g3 gif heic heif ico ief jpe jpeg jpg ktx mdi mmr npx pbm pct pcx pgm pic png pnm ppm psd ras rgb rlc sub svg svgz tif tiff uvg uvi uvvg uvvi wbmp webp wdp xbm xif xpm xwd avif jxl".split()
VIDEO = "3g2 3gp asf asx avi f4v fli flv fvt h261 h263 h264 jpgm jpgv jpm m1v m2v m4u m4v mj2 mjp2 mkv mov movie mp4 mp4v mpe mpeg mpg mpg4 mxu ogv pyv qt uvh uvm uvp uvs uvu uvv uvvh uvvm uvvp uvvs uvvu uvvv viv webm wm wmv wmx wvx".split()
OTHER = ["mts"]


def _extension(name: Column) -> Column:
    return F.lower(F.substring_index(name, ".", -1))


def is_image(name: Column) -> Column:
    return F.contains(name, F.lit(".")) & _extension(name).isin(IMAGE)


def is_media(name: Column) -> Column:
    """Photos and videos; case of the extension doesn't count, unknown extensions are no media."""
    return F.contains(name, F.lit(".")) & _extension(name).isin(IMAGE + VIDEO + OTHER)
