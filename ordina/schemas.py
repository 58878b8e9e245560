"""Declared schemas; nothing is inferred, since sparse documents would lose absent fields."""

from __future__ import annotations

CATALOGUE = "`path` string, `license` string, `title` string, `song_length.bars` string, `genres` string, `n_tracks` string, `has_lyrics` string, `subset:deduplicated` string"
NOTE = "struct<time:bigint,pitch:int,duration:bigint,pitch_str:string,is_grace:boolean>"
SCORE = (
    "resolution int, metadata struct<title:string,creators:string>, "
    f"tracks array<struct<is_drum:boolean,notes:array<{NOTE}>,lyrics:array<struct<time:bigint,lyric:string>>>>, "
    "barlines array<struct<time:bigint>>, time_signatures array<struct<time:bigint,numerator:int,denominator:int>>, "
    "key_signatures array<struct<fifths:int>>"
)
BOX = "struct<staff:int,system:int,voice:int,x:int,y:int,w:int,h:int,line_spacing:double,pad_up:int,pad_down:int>"
LINE = f"piece string, page int, system int, voice int, field int, start_line int, end_line int, box {BOX}, tokens array<string>, kern string, height int, width int, font string"
PACK_LINE = "piece string, width int, offset bigint, tokens array<string>"
TOKEN_EVENT = "struct<token:string,f0:int,f1:int,confidence:double>"
PAGE = "page bigint, height int, width int, gray binary"
