"""Fixed values that results depend on: word lists, lookup tables and patterns, as they have to be.

Lists that belong to one deployment (names to ignore) are parameters of the operators, too; what stands here are their defaults.
"""

from __future__ import annotations

# Names of primitive types, compared without regard to case.
PRIMITIVE_NAMES = (
    "void", "bool", "char", "wchar_t", "char16_t", "char32_t",
    "int", "short", "long", "signed", "unsigned", "float", "double",
    "int8_t", "int16_t", "int32_t", "int64_t",
    "uint8_t", "uint16_t", "uint32_t", "uint64_t",
    "size_t", "ptrdiff_t", "intptr_t", "uintptr_t",
    "BYTE", "WORD", "DWORD", "DWORD64", "QWORD", "DWORD_PTR",
    "INT", "UINT", "LONG", "ULONG", "LONGLONG", "ULONGLONG",
    "HRESULT", "BOOL", "WCHAR", "LPSTR", "LPWSTR", "LPCSTR", "LPCWSTR",
    "time_t", "clock_t", "FILE", "DIR", "jmp_buf", "fpos_t",
    "mbstate_t", "va_list", "sig_atomic_t",
    "nullptr_t", "max_align_t", "decimal32", "decimal64", "decimal128",
    "_BYTE", "unsigned __int8", "unsigned __int16", "unsigned __int32", "unsigned __int64",
    "__int8", "__int16", "__int32", "__int64",
)

# Primitive types of more than one word.
PRIMITIVE_COMBINATIONS = (
    "unsigned int", "unsigned long", "unsigned short", "unsigned char",
    "signed int", "signed long", "signed short", "signed char",
    "long int", "long long", "long double", "short int",
    "unsigned long long", "signed long long",
)

# Sizes in bytes on x86, by name without regard to case.
PRIMITIVE_SIZES = {
    "bool": 1, "_BYTE": 1,
    "char": 1, "wchar_t": 2, "char16_t": 2, "char32_t": 4,
    "int8_t": 1, "int16_t": 2, "int32_t": 4, "int64_t": 8,
    "uint8_t": 1, "uint16_t": 2, "uint32_t": 4, "uint64_t": 8,
    "void": 0, "int": 4, "short": 2, "long": 4, "signed": 4, "unsigned": 4, "float": 4, "double": 8,
    "size_t": 4, "ptrdiff_t": 4, "intptr_t": 4, "uintptr_t": 4,
    "BYTE": 1, "WORD": 2, "DWORD": 4, "DWORD64": 8, "QWORD": 8, "DWORD_PTR": 4,
    "UINT": 4, "ULONG": 4, "LONGLONG": 8, "ULONGLONG": 8, "HRESULT": 4, "WCHAR": 2,
    "nullptr_t": 4, "time_t": 4, "clock_t": 4, "sig_atomic_t": 4,
}

# Display names of primitive types.
REMAPS = {
    "_BYTE": "byte", "_WORD": "uint16_t", "_DWORD": "uint32_t", "_QWORD": "uint64_t",
    "unsigned int": "uint32_t", "unsigned long": "uint32_t", "unsigned __int64": "uint64_t", "unsigned short": "uint16_t",
    "unsigned char": "uint8_t", "unsigned __int32": "uint32_t", "unsigned __int16": "uint16_t", "unsigned __int8": "uint8_t",
    "char": "byte",
    "int": "int32_t", "__int64": "int64_t", "signed int": "int32_t", "signed long": "int32_t", "signed short": "int16_t",
    "signed char": "int8_t", "signed __int32": "int32_t", "signed __int16": "int16_t", "signed __int8": "int8_t",
    "long double": "float64_t", "double": "float64_t", "float": "float32_t",
}

# What a C++ type is in the target language, by name without regard to case.
TARGET_TYPES = {
    "int": "int", "int32_t": "int", "__int32": "int", "long": "int", "signed": "int", "signed int": "int", "signed long": "int", "long int": "int",
    "unsigned int": "uint", "uint32_t": "uint", "unsigned __int32": "uint", "unsigned long": "uint", "DWORD": "uint", "UINT": "uint", "ULONG": "uint", "unsigned": "uint",
    "__int64": "long", "int64_t": "long", "long long": "long", "signed long long": "long", "LONGLONG": "long",
    "unsigned __int64": "ulong", "uint64_t": "ulong", "unsigned long long": "ulong", "DWORD64": "ulong", "QWORD": "ulong", "ULONGLONG": "ulong",
    "short": "short", "int16_t": "short", "__int16": "short", "short int": "short", "signed short": "short", "signed short int": "short",
    "unsigned short": "ushort", "uint16_t": "ushort", "unsigned __int16": "ushort", "unsigned short int": "ushort", "WORD": "ushort",
    "char": "sbyte", "int8_t": "sbyte", "__int8": "sbyte", "signed char": "sbyte",
    "unsigned char": "byte", "uint8_t": "byte", "unsigned __int8": "byte", "BYTE": "byte", "_BYTE": "byte",
    "bool": "byte", "float": "float", "double": "double", "long double": "double",
    "void": "void", "wchar_t": "System.Char", "WCHAR": "char", "char16_t": "char", "char32_t": "uint",
    "size_t": "nuint", "ptrdiff_t": "nint", "intptr_t": "nint", "uintptr_t": "nuint", "DWORD_PTR": "nuint",
    "void*": "System.IntPtr", "_DWORD": "int", "HRESULT": "int", "sockaddr_in": "int", "LPBYTE": "byte*", "HKEY": "int",
    "HWND__": "int", "HINSTANCE__": "int", "HACCEL__": "int", "HICON__": "int", "LPCSTR": "sbyte*", "_iobuf": "byte",
    "_IDClass": "uint", "_D3DPSHADERCAPS2_0": "_D3DVSHADERCAPS2_0", "_POINTL": "int*", "LPVOID": "System.IntPtr",
}

# Calling conventions.
CALLING_CONVENTIONS = {"__cdecl": "Cdecl", "__thiscall": "Thiscall", "__stdcall": "Stdcall", "__fastcall": "Fastcall"}

# Reserved words of the target language.
RESERVED = (
    "abstract", "as", "base", "bool", "break", "byte", "case", "catch", "char", "checked",
    "class", "const", "continue", "decimal", "default", "delegate", "do", "double", "else",
    "enum", "event", "explicit", "extern", "false", "finally", "fixed", "float", "for",
    "foreach", "goto", "if", "implicit", "in", "int", "interface", "internal", "is", "lock",
    "long", "namespace", "new", "null", "object", "operator", "out", "override", "params",
    "private", "protected", "public", "readonly", "ref", "return", "sbyte", "sealed",
    "short", "sizeof", "stackalloc", "static", "string", "struct", "switch", "this", "throw",
    "true", "try", "typeof", "uint", "ulong", "unchecked", "unsafe", "ushort", "using",
    "virtual", "void", "volatile", "while",
)

# Words that are part of a type or a declaration, never the name of a parameter.
TYPE_WORDS = (
    "int", "char", "float", "double", "bool", "void", "short", "long", "signed", "unsigned",
    "wchar_t", "char16_t", "char32_t", "auto", "nullptr_t",
    "const", "volatile", "restrict", "constexpr", "consteval", "constinit",
    "static", "extern", "register", "mutable", "thread_local",
    "inline", "virtual", "explicit", "friend", "public", "private", "protected",
    "struct", "class", "union", "enum",
    "__unaligned", "__declspec", "__cppobj", "__thiscall", "__stdcall",
    "__cdecl", "__fastcall", "__inline", "__forceinline", "__restrict", "__based",
    "__ptr32", "__ptr64", "__w64", "__try", "__except", "__finally",
)

# Types whose name ends so are left out.
IGNORED_SUFFIXES = ("_", "_tag")
# And those whose name begins so.
IGNORED_PREFIXES = (
    "_", "tag", "ATL", "WinInet", "Windows", "std", "SCARD", "SB", "RPC", "OPENCARD", "MSXML", "IMedia", "IMem", "IXML", "ISynchronize", "IOle",
    "IPersist", "IPin", "IPipe", "IProperty", "IQua", "IQeue", "IRe", "IOp", "IMe", "IMa", "IInt", "IHttp", "IGraph", "IFil", "IEn", "ICreate",
    "ICon", "D3DXTex", "tMIXERCONTROLDETAILS", "SYSTEM_", "IDirect", "DIDEVICE", "sock", "tACMSTREAMHEADER", "tWAVEFORMATEX", "signed_", "value_",
    "val_", "provider_info", "type_info", "tree_desc_s", "internal_state", "streambuf", "filebuf", "ios", "ofstream", "ostream", "protoent",
    "linger", "istream", "inflate_", "in_addr", "ifstream", "netent", "localVar", "Param", "hostent", "servent", "get_storage_type", "fstream",
    "fd_", "exception", "ct_data_s", "config_s", "_com", "XMLDOM", "URL_COMPONENTSW", "TypeDescriptor", "SHEPHANDLE", "QzCComPtr", "RASIPADDR",
    "QOS_OBJECT_HDR", "POWER_ACTION_POLICY", "PMD", "NUMPARSE", "MENUITEMTEMPLATE", "MIDIFILEHDR", "AVL", "z_stream_s", "static_tree_desc_s", "stat",
    "pvalue", "TGA", "TEMPEVENT", "IWinInet", "IWaitMultiple", "IXTLRuntime", "IType", "IStdMarshalInfo", "IROTData", "IPrintDialog", "INTRACKSTATE",
    "INFILESTATE", "IMoniker", "ILBM", "ICD", "ICIDM", "IBind", "IAsync", "IAuthenticate", "IAdvice", "IAddr", "HttpClient", "HID", "GRP",
    "FLASHWINFO", "DID", "DE", "DIP", "DIE", "DIF", "DLG", "DRVCONFIGINFOEX", "CS_STUB_INFO", "CSI", "CPPEH_RECORD", "CONFIRMSAFETY",
    "CM_Power_Data_s", "BITMAPV", "BATTERY_REPORTING_SCALE", "ALP", "AM_SEEKING", "CubeTexture", "ADDRESS_MODE", "BlitFormat", "_bstr_t", "_STL",
    "XLAT_SIDE", "VXDINSTANCE", "WTimer", "WLogSystem", "STUB_PHASE", "SQFL", "ReplacesCorHdrNumericDefines", "RDBBitmask", "PROXY_PHASE",
    "POWER_INFORMATION_LEVEL", "POWER_ACTION", "PIDMSI_STATUS_VALUE", "OfflineFolderStatus", "MySTLSortFunction_LRU", "LSA_FOREST_TRUST_RECORD_TYPE",
    "LMINMAX", "LIST_ENTRY", "LATENCY_TIME", "IUrlMon", "IThumbnailExtractor", "ITimeAndNoticeControl", "ISurrogate", "ISupportErrorInfo",
    "ISoftDistExt", "IServiceProvider", "IRootStorage", "IRunnableObject", "IRunningObject", "CSeekingPassThru", "ISeekingPassThru",
    "IPSFactoryBuffer", "IProgressNotify", "IProcessInitControl", "IPropertyBag", "IParseDisplayName", "IObjectWithSite", "IObjectFactory",
    "INTERNET_SCHEME", "IMultiQI", "AsyncIMultiQI", "IMAGE_LOAD_CONFIG_DIRECTORY", "IMAGE_COR20_HEADER", "IMAGE_AUX_SYMBOL", "ILockBytes",
    "ILayoutStorage", "IForegroundTransfer", "IGlobalInterfaceTable", "IExternalConnection", "IError", "IDummyHICONIncluder", "ICSETSTATUSPROC",
    "IComThreadingInfo", "ICodeInstall", "IWindowForBindingUI", "IClassFactory", "ICatRegister", "ICatalogFileInfo", "ICancelMethodCalls",
    "ICallFactory", "IBlockingLock", "IBaseFilter", "IAdviseSink", "FOURCCMap", "CMsg", "CEm", "CEd", "CAutoUsingOutputPin", "BIDI_TYPE",
    "IMPORT_OBJECT_HEADER", "FallocPool", "IntrusiveLFData", "Intrusive_MW", "ANON_OBJECT_HEADER", "ANSIColorStatus", "ARRAY_INFO", "CHid'", "CBase",
    "CDeferredCommand", "IDeferredCommand", "CDispParams", "CDynamicOutputPin", "CEnum", "CMedia", "CBasicAudio", "CGenericList", "CHid",
    "CMemAllocator", "CPosPassThru", "CRendererPosPassThru", "CSourceSeeking", "FT", "InteractiveOutputHandler", "LogTextTypeEnumMapper", "LookFile",
    "ProjectSettings", "Resource", "UDATE", "CRendererInputPin", "CTextureRenderer", "CCmdQueue", "CSourcePosition", "SerializationBehavior",
)
# And these are kept all the same.
KEPT_NAMES = (
    "_IDClass", "D3DPolyRender", "_GUID", "IFileNodeName", "IFileNodeName_vtbl", "_tagDataID", "_tag", "_tagVersionHandle", "_tagCellID", "tagPOINT",
    "CEmoteTable", "tagRECT", "_D3DPOOL", "_D3DFORMAT", "tWAVEFORMATEX", "IOptionChangeHandler", "_PUBLICKEYSTRUC", "_SECURITY_DESCRIPTOR",
    "_RTL_CRITICAL_SECTION", "_MMCKINFO", "CBaseQualities", "CBaseQualities_vtbl", "CBasePiece", "tagBLOB", "IObjectFactory", "_D3DLIGHT9",
    "_D3DLIGHTTYPE", "_D3DCOLORVALUE", "_D3DVECTOR", "ICIDM", "ICIDM_vtbl", "IResourceNotify", "_WSABUF", "SCARD_T0_COMMAND", "HIDREPORTINFO",
    "_D3DMATERIAL9", "_InstanceID", "_D3DMATRIX", "_D3DDEVTYPE", "_D3DCAPS9", "_D3DRESOURCETYPE", "_D3DPRIMITIVETYPE", "_D3DVSHADERCAPS2_0",
    "IConsoleCallbackObject", "_LARGE_INTEGER", "_ULARGE_INTEGER",
)

# The line before a definition, and the line before a function body.
DEFINITION_MARK = r"/\*\s*\d+\s*\*/"
FUNCTION_MARK = r"^//-+ \(([0-9A-F]+)\) -+"
# A line of a listing of static variables.
STATIC_LINE = r"^([0-9A-F]{16})\s+(.+?)\s+\d+\s+bytes\s+\[(.+?)\]$"
