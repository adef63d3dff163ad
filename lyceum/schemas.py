"""Schemas of stored tables, as DDL; optional fields are nullable, nothing is inferred."""

RAW = (
    "raw_id string, college_name string, url string, page_type string, content_type string, raw_content string, "
    "raw_html string, extraction_date timestamp, metadata struct<http_status:int,crawler_session:string,depth:int,"
    "parent_id:string,table_index:int,content_length:bigint,file_extension:string>"
)
TARGET = (
    "name string, alias array<string>, base_url string, admission_paths array<string>, placement_paths array<string>, "
    "domain string"
)
NO_TABLES = "array<struct<table_index:int,headers:array<string>,raw_rows:array<array<string>>,text:string>>"
SPAN_LINES = "array<struct<spans:array<struct<text:string,x:double,y:double,font:string,size:double,flags:int>>>>"
SPAN_PAGE = (
    "path string, page int, blocks array<struct<type:int,lines:array<struct<spans:array<struct<text:string,origin:array<double>,"
    "font:string,size:double,flags:int>>>>>>"
)
