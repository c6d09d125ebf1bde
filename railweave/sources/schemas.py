"""Schemas of the documents that are read and written."""

#: Field names, versions and institution codes of the format.
STOP = "struct<name:string,station:string,n02_station_code:string,N02_005c:string,arrival:string,departure:string,stop_type:string,ride_segment:boolean>"
SECTION = "struct<`from`:string,`to`:string,from_n02_station_code:string,to_n02_station_code:string,line_names:array<string>,operator_names:array<string>,operator_hints:array<string>,number:string,name:string>"
STYLE = "struct<color:string,weight:double,unridden_opacity:double>"
POLICY = "struct<mode:string,jr_only:boolean,allow_alternatives:boolean,allow_browser_straight_line_fallback:boolean,allowed_institution_type_codes:array<string>,preferred_line_names:array<string>,preferred_operator_names:array<string>,institution_filter_mode:string>"
TRAIN = f"struct<id:string,date:string,number:string,name:string,origin:string,destination:string,direction:string,visible:boolean,style:{STYLE},route_policy:{POLICY},route_sections:array<{SECTION}>,stops:array<{STOP}>>"
STORE = f"struct<schema_version:string,trains:array<{TRAIN}>>"
LINES = "array<array<struct<lon:double,lat:double>>>"
VERSIONS = ("1.2", "1.3")
INSTITUTIONS = ("1", "2", "3", "4", "5")
EVENT = "type string, at timestamp, origin string, source string, mode string, trains int, cleared boolean, seq bigint, id string, payload string"
