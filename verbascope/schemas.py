"""Fixed schemas of the domain tables.

Media time is DOUBLE seconds from the start of the recording. The interval
columns are called ``start_s`` / ``end_s`` so that they need no quoting in SQL;
readers rename the JSON keys ``start`` / ``end`` on the way in. Schemas are DDL text, so importing them needs no session.
"""

WORD_JSON = "struct<word:string,start:double,end:double,speaker:string,probability:double,corrected:string>"
SEGMENT_JSON = f"struct<id:int,start:double,end:double,text:string,speaker:string,corrected_text:string,words:array<{WORD_JSON}>>"

TRANSCRIPT_JSON = (
    "task string, language string, text string, file_id string, request_id string, "
    f"meta map<string,string>, words array<{WORD_JSON}>, segments array<{SEGMENT_JSON}>"
)

VOCAB_JSON = (
    "terms array<struct<term:string,category:string,known_errors:array<string>>>"
)

EXAMPLE_JSON = (
    "messages array<struct<role:string,content:string>>, "
    "metadata struct<source:string,accent:string,term:string,category:string,error_found:string,"
    "file_id:string,applied:boolean,is_negative:boolean,is_hard_negative:boolean,has_ocr:boolean>, "
    "_raw string"
)

FRAME = ("file_id bigint, ts double, type string, text string")
SNIPPET = ("query_key string, rank int, title string, body string")
