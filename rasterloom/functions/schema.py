"""Spark types of results: one envelope per row, whatever happens to its blob."""

ERROR = "struct<kind:string,format:string,message:string,stage:string,reason:string,offset:bigint,identity:string,resource:string,maximum:bigint,observed:bigint,minimum:bigint>"
DIAGNOSTICS = "array<struct<kind:string,stage:string,offset:bigint,identity:string>>"
HOTSPOT = "struct<x:int,y:int>"
INFO = f"struct<format:string,width:bigint,height:bigint,mode:string,bit_depth:int,frame_count:bigint,is_animated:boolean,cursor_hotspot:{HOTSPOT},byte_order:string,decoded_bytes:bigint>"
BLOCKS = "array<struct<kind:binary,data:binary>>"
COLOR = "struct<srgb_intent:int,gamma:bigint,chromaticities:array<bigint>,icc:struct<keyword:binary,data:binary>>"
IMAGE = f"struct<format:string,width:bigint,height:bigint,mode:string,pixels:binary,palette_rgb:binary,palette_alpha:binary,cursor_hotspot:{HOTSPOT},alpha:string,byte_order:string,blocks:{BLOCKS},metadata:{BLOCKS},color:{COLOR}>"
RECT = "struct<left:bigint,top:bigint,width:bigint,height:bigint>"
FRAME = f"struct<frame_index:int,frame_count:int,kind:string,layout:string,canvas_width:bigint,canvas_height:bigint,loop_count:bigint,rect:{RECT},duration:struct<num:bigint,den:bigint>,disposal:int,blend:string,interlaced:boolean,image:{IMAGE}>"


def envelope(value: str) -> str:
    return f"ok boolean, value {value}, consumed_bytes bigint, diagnostics {DIAGNOSTICS}, error {ERROR}"
