"""Grammars of the languages whose files are checked, in extended BNF.

Token classes: a identifier, 0 number, " string or other literal. They state syntax as a set of token strings;
operator precedence does not change that set, so operands and operators are flat lists.
"""

from __future__ import annotations

JSON = """
Text : Value ;
Value : '{' ( Pair ( ',' Pair )* )? '}' | '[' ( Value ( ',' Value )* )? ']' | '"' | '0' | 'true' | 'false' | 'null' ;
Pair : '"' ':' Value ;
"""

# Reserved words of ECMAScript modules, and words that are reserved in some places only.
JS_KEYWORDS = (
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null "
    "return super switch this throw true try typeof var void while with let static yield await async of get set from as"
).split()
JS_SOFT = "static async of get set from as let await yield".split()
TS_KEYWORDS = JS_KEYWORDS + (
    "abstract any asserts declare infer interface is keyof module namespace never readonly require type unique implements private protected public override satisfies accessor out global"
).split()
TS_SOFT = JS_SOFT + [w for w in TS_KEYWORDS if w not in JS_KEYWORDS]


def _ecmascript(ts: bool) -> str:
    keywords, soft = (TS_KEYWORDS, TS_SOFT) if ts else (JS_KEYWORDS, JS_SOFT)
    hard = [w for w in keywords if w not in soft]
    marks = {
        "@ann": "Ann?" if ts else "", "@tparams": "TypeParams?" if ts else "", "@targs": "TypeArgs?" if ts else "", "@opt": "'?'?" if ts else "",
        "@optbang": "( '?' | '!' )?" if ts else "", "@ret": "RetAnn?" if ts else "", "@pmods": "ParamMod*" if ts else "", "@impl": "Implements?" if ts else "",
        "@mods": "MemberMod*" if ts else "'static'?", "@body": "( '{' Stmt* '}' | End )" if ts else "'{' Stmt* '}'", "@abstract": "'abstract'?" if ts else "",
        "@typeonly": "'type'?" if ts else "", "@decos": "Decorator*",
    }
    text = """
Program : Stmt* ;
End : ';' | 'ASI' ;
Ident : 'a' | %(soft)s ;
Name : Ident | %(hard)s ;
Stmt : Block | ';' | Declare | VarDecl End | ExprNB End | 'if' '(' Expr ')' Stmt ( 'else' Stmt )? | Loop | 'continue' Ident? End | 'break' Ident? End
     | 'return' Expr? End | 'with' '(' Expr ')' Stmt | 'switch' '(' Expr ')' '{' Case* '}' | 'throw' Expr End | Try | 'debugger' End | Ident ':' Stmt | Import | Export %(stmts)s ;
Block : '{' Stmt* '}' ;
Declare : Function | Class %(declares)s ;
VarDecl : ( 'var' | 'let' | 'const' ) Binding ( ',' Binding )* ;
Binding : Target @bang @ann ( '=' Assign )? ;
Target : Ident | Pattern ;
Pattern : '[' ','* ( Element ( ','+ Element )* ','* )? ']' | '{' ( Prop ( ',' Prop )* ','? )? '}' ;
Element : '...'? Target ( '=' Assign )? ;
Prop : Ident ( '=' Assign )? | Key ':' Target ( '=' Assign )? | '...' Target ;
Loop : 'for' 'await'? '(' ForHead ')' Stmt | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' End? ;
ForHead : ( VarDecl | Expr )? ';' Expr? ';' Expr? | ( ( 'var' | 'let' | 'const' ) Target | LHS ) ( 'in' Expr | 'of' Assign ) ;
Case : ( 'case' Expr | 'default' ) ':' Stmt* ;
Try : 'try' Block ( 'catch' ( '(' Target @ann ')' )? Block ( 'finally' Block )? | 'finally' Block ) ;
Function : 'async'? 'function' '*'? Ident @tparams '(' Params ')' @ret @body ;
Params : ( Param ( ',' Param )* ','? )? ;
Param : @decos @pmods '...'? Target @opt @ann ( '=' Assign )? %(thisparam)s ;
Class : @decos @abstract 'class' Ident? @tparams ( 'extends' LHS )? @impl '{' Member* '}' ;
Decorator : '@' ( Ident ( '.' Name )* ( '(' Args ')' )? | '(' Expr ')' ) ;
Member : ';' | 'static' Block | @decos @mods Key @optbang @ann ( '=' Assign )? End
       | @decos @mods 'async'? '*'? Key @opt @tparams '(' Params ')' @ret @body | @decos @mods ( 'get' | 'set' ) Key '(' Params ')' @ret @body %(members)s ;
Key : Name | '"' | '0' | '[' Assign ']' | '#' Name ;
Import : 'import' ( '"' | @typeonly Clause 'from' '"' ) ( ( 'with' | 'a' ) Object )? End ;
Clause : Ident ( ',' ( Names | Star ) )? | Names | Star ;
Star : '*' 'as' Ident ;
Names : '{' ( Specifier ( ',' Specifier )* ','? )? '}' ;
Specifier : @typeonly ModuleName ( 'as' ModuleName )? ;
ModuleName : Name | '"' ;
Export : 'export' ( Declare | VarDecl End | 'default' ( 'async'? 'function' '*'? Ident? @tparams '(' Params ')' @ret @body | Class | AssignNB End %(defaults)s )
       | @typeonly Names ( 'from' '"' ( ( 'with' | 'a' ) Object )? )? End | @typeonly '*' ( 'as' ModuleName )? 'from' '"' ( ( 'with' | 'a' ) Object )? End %(exports)s ) ;
Expr : Assign ( ',' Assign )* ;
Assign : Cond | LHS AssignOp Assign | Arrow | 'yield' ( '*'? Assign )? ;
Arrow : 'async'? ( Ident | @tparams '(' Params ')' @ret ) '=>' ( '{' Stmt* '}' | AssignNB ) ;
AssignOp : '=' | 'op=' ;
Cond : Binary ( '?' Assign ':' Assign )? ;
Binary : Unary ( BinOp Unary )* ;
BinOp : 'op' | '*' | '+-' | '<' | '>' | '>' '>' | '>' '>' '>' | 'in' | 'instanceof' ;
Unary : ( Prefix )* Postfix ;
Prefix : 'delete' | 'void' | 'typeof' | 'await' | '+-' | '!' | '++' ;
Postfix : LHS '++'? | '#' Name ;
LHS : Primary Suffix* | 'new' '.' Name Suffix* | New ;
New : 'new' ( New | Primary NewSuffix* @targs '(' Args ')' Suffix* | Primary NewSuffix* ) ;
NewSuffix : '.' '#'? Name | '[' Expr ']' ;
Suffix : '.' '#'? Name | '?.' ( '#'? Name | '[' Expr ']' | '(' Args ')' ) | '[' Expr ']' | '(' Args ')' | Template %(suffixes)s ;
Args : ( Arg ( ',' Arg )* ','? )? ;
Arg : '...'? Assign ;
Primary : PrimaryNB | Object ;
PrimaryNB : Ident | 'this' | 'super' | 'null' | 'true' | 'false' | '0' | '"' | Template | Array | '(' Expr ')' | FunctionExpr | Class | 'import' '(' Args ')' | 'import' '.' Name %(primaries)s ;
FunctionExpr : 'async'? 'function' '*'? Ident? @tparams '(' Params ')' @ret '{' Stmt* '}' ;
Template : '`' | Template '<<' Expr '>>' ;
Array : '[' ','* ( Arg ( ','+ Arg )* ','* )? ']' ;
Object : '{' ( Entry ( ',' Entry )* ','? )? '}' ;
Entry : Ident ( '=' Assign )? | Key ':' Assign | '...' Assign | 'async'? '*'? Key @tparams '(' Params ')' @ret '{' Stmt* '}' | ( 'get' | 'set' ) Key '(' Params ')' @ret '{' Stmt* '}' ;
ExprNB : AssignNB ( ',' Assign )* ;
AssignNB : CondNB | LHSNB AssignOp Assign | Arrow | 'yield' ( '*'? Assign )? ;
CondNB : BinaryNB ( '?' Assign ':' Assign )? ;
BinaryNB : UnaryNB ( BinOp Unary )* ;
UnaryNB : Prefix+ Postfix | PostfixNB ;
PostfixNB : LHSNB '++'? | '#' Name ;
LHSNB : PrimaryNB Suffix* | 'new' '.' Name Suffix* | New ;
""".replace("@bang", "'!'?" if ts else "")
    extra = {k: "" for k in ("stmts", "declares", "thisparam", "members", "defaults", "exports", "suffixes", "primaries")}
    if ts:
        extra = {
            "stmts": "", "declares": "| Interface | Alias | Enum | Namespace | 'declare' Ambient",
            "thisparam": "| 'this' Ann", "members": "| @mods Index End".replace("@mods", "MemberMod*"),
            "defaults": "| Interface | 'abstract' Class", "exports": "| '=' Expr End | 'as' 'namespace' Ident End | 'import' Ident '=' ModuleRef End",
            "suffixes": "| '!' | TypeArgs '(' Args ')' | TypeArgs Template | '?.' TypeArgs '(' Args ')'",
            "primaries": "",
        }
        text = text.replace("BinOp : 'op'", "BinOp : 'op'").replace("Binary : Unary ( BinOp Unary )* ;", "Binary : Unary ( BinOp Unary | AsType )* ;")
        text = text.replace("BinaryNB : UnaryNB ( BinOp Unary )* ;", "BinaryNB : UnaryNB ( BinOp Unary | AsType )* ;")
        text = text.replace("Prefix : 'delete'", "Prefix : '<' Type '>' | 'delete'")
        text = text.replace("( 'extends' LHS )?", "( 'extends' LHS TypeArgs? )?").replace("Import : ", "Import : 'import' @typeonly Ident '=' ModuleRef End | ")
        text += """
AsType : ( 'as' | 'satisfies' ) ( Type | 'const' ) ;
ModuleRef : 'require' '(' '"' ')' | Ident ( '.' Name )* ;
Ann : ':' Type ;
RetAnn : ':' ( Type | Predicate ) ;
Predicate : 'asserts'? ( Ident | 'this' ) 'is' Type | 'asserts' ( Ident | 'this' ) ;
TypeParams : '<' TypeParam ( ',' TypeParam )* ','? '>' ;
TypeParam : ( 'const' | 'in' | 'out' )* Ident ( 'extends' Type )? ( '=' Type )? ;
TypeArgs : '<' Type ( ',' Type )* ','? '>' ;
ParamMod : 'public' | 'private' | 'protected' | 'readonly' | 'override' ;
MemberMod : 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'static' | 'abstract' | 'declare' | 'accessor' ;
Implements : 'implements' TypeRef ( ',' TypeRef )* ;
Interface : 'interface' Ident TypeParams? ( 'extends' TypeRef ( ',' TypeRef )* )? ObjectType ;
Alias : 'type' Ident TypeParams? '=' Type End ;
Enum : 'const'? 'enum' Ident '{' ( EnumItem ( ',' EnumItem )* ','? )? '}' ;
EnumItem : ( Name | '"' | '[' '"' ']' ) ( '=' Assign )? ;
Namespace : ( 'namespace' | 'module' ) ( Ident ( '.' Ident )* | '"' ) ( Block | End ) | 'global' Block ;
Ambient : Declare | VarDecl End ;
Type : CondType | FunctionType ;
FunctionType : 'abstract'? 'new'? TypeParams? '(' Params ')' '=>' ( Type | Predicate ) ;
CondType : UnionType ( 'extends' UnionType '?' Type ':' Type )? ;
UnionType : '|'? MeetType ( '|' MeetType )* | '|'? MeetType ( '|' MeetType )* '|' FunctionType ;
MeetType : '&'? PrefixType ( '&' PrefixType )* ;
PrefixType : ( 'keyof' | 'unique' | 'readonly' )* PostfixType | 'infer' Ident ( 'extends' Type )? ;
PostfixType : BaseType ( '[' Type? ']' )* ;
BaseType : TypeRef | '"' | '+-'? '0' | 'true' | 'false' | 'null' | 'void' | 'this' | 'typeof' ( Ident | 'this' | 'import' '(' '"' ')' ) ( '.' '#'? Name )* TypeArgs?
         | ObjectType | '[' ( TupleItem ( ',' TupleItem )* ','? )? ']' | '(' Type ')' | 'import' '(' '"' ')' ( '.' Name )* TypeArgs? | TypeTemplate ;
TypeTemplate : '`' | TypeTemplate '<<' Type '>>' ;
TypeRef : Ident ( '.' Name )* TypeArgs? ;
TupleItem : '...'? Type '?'? | '...'? Name '?'? ':' Type ;
ObjectType : '{' ( TypeMember ( TypeEnd TypeMember )* TypeEnd? )? '}' | Mapped ;
TypeEnd : ';' | ',' | 'ASI' ;
TypeMember : MemberMod* Key '?'? Ann? | Key '?'? TypeParams? '(' Params ')' RetAnn? | 'new'? TypeParams? '(' Params ')' RetAnn? | MemberMod* Index
           | ( 'get' | 'set' ) Key '(' Params ')' RetAnn? ;
Index : '[' Ident ':' Type ']' Ann? ;
Mapped : '{' ( ( '+-' )? 'readonly' )? '[' Ident 'in' Type ( 'as' Type )? ']' ( ( '+-' )? '?' )? Ann? TypeEnd? '}' ;
"""
        text = text.replace("BinOp : 'op' |", "BinOp : 'op' | '|' | '&' |")
    text = text % {"soft": " | ".join(f"'{w}'" for w in soft), "hard": " | ".join(f"'{w}'" for w in hard), **extra}
    for k, v in sorted(marks.items(), key=lambda x: -len(x[0])):
        text = text.replace(k, v)
    return text


JAVASCRIPT, TYPESCRIPT = _ecmascript(False), _ecmascript(True)

# Reserved words of Python 3, and soft keywords.
PY_KEYWORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise "
    "return try while with yield match case type"
).split()

PYTHON = """
File : Stmt* ;
Name : 'a' | 'match' | 'case' | 'type' ;
Stmt : Simple | Compound ;
Simple : Small ( ';' Small )* ';'? 'NL' ;
Small : 'pass' | 'break' | 'continue' | 'return' Stars? | 'raise' ( Test ( 'from' Test )? )? | 'global' Name ( ',' Name )* | 'nonlocal' Name ( ',' Name )*
      | 'del' DelTargets | 'assert' Test ( ',' Test )? | ImportStmt | ExprStmt | 'type' Name TypeParams? '=' Test ;
ExprStmt : Stars | Yield | ( StarTargets '=' )+ ( Stars | Yield ) | Single 'op=' ( Stars | Yield ) | ( Single | '(' Single ')' ) ':' Test ( '=' ( Stars | Yield ) )? ;
StarTargets : StarTarget ( ',' StarTarget )* ','? ;
StarTarget : '*'? OneTarget ;
OneTarget : Single | '(' StarTargets? ')' | '[' StarTargets? ']' ;
Single : Name | Primary '.' Name | Primary '[' Slices ']' ;
DelTargets : DelTarget ( ',' DelTarget )* ','? ;
DelTarget : Single | '(' DelTargets? ')' | '[' DelTargets? ']' ;
ImportStmt : 'import' Dotted ( 'as' Name )? ( ',' Dotted ( 'as' Name )? )* | 'from' Dots* Dotted 'import' Imported | 'from' Dots+ 'import' Imported ;
Dots : '.' | '...' ;
Dotted : Name ( '.' Name )* ;
Imported : '*' | ImportAs ( ',' ImportAs )* | '(' ImportAs ( ',' ImportAs )* ','? ')' ;
ImportAs : Name ( 'as' Name )? ;
Suite : 'NL' 'IN' Stmt+ 'OUT' | Simple ;
Compound : 'if' Named ':' Suite Elif* Else? | 'while' Named ':' Suite Else? | 'async'? 'for' StarTargets 'in' Stars ':' Suite Else? | Try | 'async'? With
         | Decorator* 'async'? 'def' Name TypeParams? '(' Params ')' ( '->' Test )? ':' Suite | Decorator* 'class' Name TypeParams? ( '(' Args ')' )? ':' Suite
         | 'match' Stars ':' 'NL' 'IN' CaseBlock+ 'OUT' ;
Elif : 'elif' Named ':' Suite ;
Else : 'else' ':' Suite ;
Try : 'try' ':' Suite ( Except+ Else? Finally? | ExceptStar+ Else? Finally? | Finally ) ;
Except : 'except' ( Test ( ',' Test )* ( 'as' Name )? )? ':' Suite ;
ExceptStar : 'except' '*' Test ( 'as' Name )? ':' Suite ;
Finally : 'finally' ':' Suite ;
With : 'with' WithItem ( ',' WithItem )* ':' Suite | 'with' '(' WithItem ( ',' WithItem )* ','? ')' ':' Suite ;
WithItem : Test ( 'as' OneTarget )? ;
Decorator : '@' Named 'NL' ;
CaseBlock : 'case' Patterns ( 'if' Named )? ':' Suite ;
Patterns : MaybeStar ( ',' MaybeStar )* ','? ;
MaybeStar : '*' Name | AsPattern ;
AsPattern : OrPattern ( 'as' Name )? ;
OrPattern : ClosedPattern ( '|' ClosedPattern )* ;
ClosedPattern : '+-'? '0' ( '+-' '0' )? | Strings | 'None' | 'True' | 'False' | Dotted | Dotted '(' ( PatArg ( ',' PatArg )* ','? )? ')' | '(' Patterns? ')' | '[' Patterns? ']'
              | '{' ( MapItem ( ',' MapItem )* ','? )? '}' ;
PatArg : ( Name '=' )? AsPattern ;
MapItem : ( '+-'? '0' | Strings | Dotted | 'None' | 'True' | 'False' ) ':' AsPattern | '**' Name ;
TypeParams : '[' TypeParam ( ',' TypeParam )* ','? ']' ;
TypeParam : ( '*' | '**' )? Name ( ':' Test )? ( '=' Test )? ;
Params : ( PlainParams ( ',' DefaultParams )? ( ',' StarParams )? ','? | DefaultParams ( ',' StarParams )? ','? | StarParams ','? )? ;
PlainParams : PlainParam ( ',' PlainParam )* ( ',' '/' )? ( ',' PlainParam )* ;
PlainParam : Name ( ':' Test )? ;
DefaultParams : DefaultParam ( ',' DefaultParam )* ( ',' '/' )? ( ',' DefaultParam )* ;
DefaultParam : Name ( ':' Test )? '=' Test ;
StarParams : '*' Name ( ':' '*'? Test )? ( ',' KeyParam )* ( ',' KeyRest )? | '*' ( ',' KeyParam )+ ( ',' KeyRest )? | KeyRest ;
KeyParam : PlainParam | DefaultParam ;
KeyRest : '**' Name ( ':' Test )? ;
LambdaParams : ( LambdaPlain ( ',' LambdaDefault )? ( ',' LambdaStar )? ','? | LambdaDefault ( ',' LambdaStar )? ','? | LambdaStar ','? )? ;
LambdaPlain : Name ( ',' Name )* ( ',' '/' )? ( ',' Name )* ;
LambdaDefault : Name '=' Test ( ',' Name '=' Test )* ( ',' '/' )? ( ',' Name '=' Test )* ;
LambdaStar : '*' Name ( ',' Name ( '=' Test )? )* ( ',' '**' Name )? | '*' ( ',' Name ( '=' Test )? )+ ( ',' '**' Name )? | '**' Name ;
Stars : StarOr ( ',' StarOr )* ','? ;
StarOr : '*' Binary | Named ;
Named : Test | Name ':=' Test ;
Test : Or ( 'if' Or 'else' Test )? | 'lambda' LambdaParams ':' Test ;
Or : Not ( ( 'and' | 'or' ) Not )* ;
Not : 'not'* Compare ;
Compare : Binary ( CompOp Binary )* ;
CompOp : 'cmp' | 'in' | 'not' 'in' | 'is' | 'is' 'not' ;
Binary : Unary ( ( 'op' | '|' | '*' | '**' | '+-' | '/' | '@' ) Unary )* ;
Unary : ( '+-' | '~' )* 'await'? Primary ;
Primary : Atom | Primary '.' Name | Primary '(' Args ')' | Primary '[' Slices ']' ;
Slices : Slice ( ',' Slice )* ','? ;
Slice : Named | '*' Binary | Test? ':' Test? ( ':' Test? )? ;
Atom : Name | '0' | Strings | 'None' | 'True' | 'False' | '...' | '(' ( Stars | Yield | Named Comp )? ')' | '[' ( Stars | StarOr Comp )? ']'
     | '{' ( DictItem ( ',' DictItem )* ','? | Test ':' Test Comp | Stars | StarOr Comp )? '}' ;
DictItem : Test ':' Test | '**' Binary ;
Comp : ( 'async'? 'for' StarTargets 'in' Or ( 'if' CompIf )* )+ ;
CompIf : Or | Name ':=' Test | 'lambda' LambdaParams ':' Test ;
Yield : 'yield' ( 'from' Test | Stars )? ;
Args : ( PosArg ( ',' PosArg )* ( ',' KeyArg ( ',' AnyKeyArg )* )? ','? | KeyArg ( ',' AnyKeyArg )* ','? | Named Comp )? ;
PosArg : Named | '*' Test ;
KeyArg : Name '=' Test | '**' Test ;
AnyKeyArg : KeyArg | '*' Test ;
Strings : String+ ;
String : '"' | 'F' ( '<<' FExpr '>>' )* ;
FExpr : ( Stars | Yield ) '='? ;
"""

GO_KEYWORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()

# As empty files count as valid, a file that lacks its package clause does too: the clause is optional here.
GO = """
File : ( 'package' 'a' ';' )? ( ImportDecl ';' )* ( Top ';' )* ;
ImportDecl : 'import' ( ImportSpec | '(' ( ImportSpec ( ';' ImportSpec )* ';'? )? ')' ) ;
ImportSpec : ( 'a' | '.' )? '"' ;
Top : Decl | Func ;
Decl : 'const' ( ConstSpec | '(' ( ConstSpec ( ';' ConstSpec )* ';'? )? ')' ) | 'var' ( VarSpec | '(' ( VarSpec ( ';' VarSpec )* ';'? )? ')' )
     | 'type' ( TypeSpec | '(' ( TypeSpec ( ';' TypeSpec )* ';'? )? ')' ) ;
Idents : 'a' ( ',' 'a' )* ;
ConstSpec : Idents ( Type? '=' Exprs )? ;
VarSpec : Idents ( Type ( '=' Exprs )? | '=' Exprs ) ;
TypeSpec : 'a' TypeParams? '='? Type ;
TypeParams : '[' TypeParam ( ',' TypeParam )* ','? ']' ;
TypeParam : Idents Constraint ;
Constraint : Term ( '|' Term )* ;
Term : '~'? Type ;
Func : 'func' ( '(' ParamList ')' )? 'a' TypeParams? Signature Block? ;
Signature : '(' ParamList ')' Result? ;
Result : Type | '(' ParamList ')' ;
ParamList : ( Param ( ',' Param )* ','? )? ;
Param : 'a'? '...'? Type ;
Type : TypeName | '*' Type | '[' ']' Type | '[' ( Expr | '...' ) ']' Type | 'map' '[' Type ']' Type | 'chan' Type | 'chan' '<-' Type | '<-' 'chan' Type | 'func' Signature
     | Struct | 'interface' '{' ( IfaceItem ( ';' IfaceItem )* ';'? )? '}' | '(' Type ')' ;
TypeName : 'a' ( '.' 'a' )? ( '[' Type ( ',' Type )* ','? ']' )? ;
Struct : 'struct' '{' ( Field ( ';' Field )* ';'? )? '}' ;
Field : ( Idents Type | '*'? TypeName ) '"'? ;
IfaceItem : 'a' Signature | Constraint ;
Block : '{' Stmts '}' ;
Stmts : ( Stmt? ';' )* Stmt? ;
Stmt : Decl | SimpleStmt | 'go' Expr | 'defer' Expr | 'return' Exprs? | 'break' 'a'? | 'continue' 'a'? | 'goto' 'a' | 'fallthrough' | Block | If | Switch | Select | For | 'a' ':' Stmt? ;
SimpleStmt : Expr | Expr '<-' Expr | Expr '++' | Exprs ( '=' | 'op=' | ':=' ) Exprs ;
If : 'if' ( SimpleStmt? ';' )? SimpleStmt Block ( 'else' ( If | Block ) )? ;
Switch : 'switch' ( SimpleStmt? ';' )? SimpleStmt? '{' Case* '}' ;
Case : ( 'case' CaseItem ( ',' CaseItem )* | 'default' ) ':' Stmts ;
CaseItem : Expr | Type ;
Select : 'select' '{' Comm* '}' ;
Comm : ( 'case' SimpleStmt | 'default' ) ':' Stmts ;
For : 'for' ( SimpleStmt? ';' SimpleStmt? ';' SimpleStmt? | ( Exprs ( '=' | ':=' ) )? 'range' Expr | SimpleStmt )? Block ;
Exprs : Expr ( ',' Expr )* ;
Expr : Unary ( BinOp Unary )* ;
BinOp : 'op' | '*' | '+-' | '|' | '&' | '^' ;
Unary : ( '+-' | '!' | '*' | '&' | '<-' | '~' | '^' )* Primary ;
Primary : Operand | Primary '.' ( 'a' | '(' ( Type | 'type' ) ')' ) | Primary '[' Index ']' | Primary '(' CallArgs ')' | Primary Literal ;
Index : TypeOrExpr ( ',' TypeOrExpr )* ','? | Expr? ':' Expr? ( ':' Expr )? ;
TypeOrExpr : Expr | Type ;
CallArgs : ( TypeOrExpr ( ',' TypeOrExpr )* '...'? ','? )? ;
Operand : 'a' | '0' | '"' | '(' TypeOrExpr ')' | 'func' Signature Block | LitType ( Literal | '(' CallArgs ')' ) ;
LitType : '[' ']' Type | '[' ( Expr | '...' ) ']' Type | 'map' '[' Type ']' Type | Struct | 'chan' Type | 'interface' '{' '}' ;
Literal : '{' ( Elem ( ',' Elem )* ','? )? '}' ;
Elem : ( ElemValue ':' )? ElemValue ;
ElemValue : Expr | Literal ;
"""

RUST_KEYWORDS = (
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true "
    "type unsafe use where while union macro_rules default auto"
).split()

RUST = """
File : InnerAttr* Item* ;
Id : 'a' | 'union' | 'macro_rules' | 'default' | 'auto' ;
Attr : '#' '[' Tree* ']' ;
InnerAttr : '#' '!' '[' Tree* ']' ;
Tree : '(' Tree* ')' | '[' Tree* ']' | '{' Tree* '}' | Leaf ;
Leaf : %(leaves)s ;
Vis : 'pub' ( '(' ( 'crate' | 'self' | 'super' | 'in' Path ) ')' )? ;
Item : Attr* Vis? ItemBody | Attr* MacroItem ;
ItemBody : 'mod' Id ( ';' | '{' InnerAttr* Item* '}' ) | 'extern' 'crate' ( Id | 'self' ) ( 'as' Id )? ';' | 'use' UseTree ';' | Fn | 'type' Id Generics? ( ':' Bounds? )? Where? ( '=' Type )? Where? ';'
         | Struct | Enum | 'union' Id Generics? Where? '{' ( NamedField ( ',' NamedField )* ','? )? '}' | 'const' Id ':' Type ( '=' Expr )? ';' | 'static' 'mut'? Id ':' Type ( '=' Expr )? ';'
         | 'unsafe'? 'auto'? 'trait' Id Generics? ( ':' Bounds? )? Where? '{' InnerAttr* Item* '}' | 'default'? 'unsafe'? 'impl' Generics? 'const'? ( '!'? Type 'for' )? Type Where? '{' InnerAttr* Item* '}'
         | 'unsafe'? 'extern' '"'? '{' InnerAttr* Item* '}' ;
MacroItem : Path '!' Id? ( '(' Tree* ')' ';' | '[' Tree* ']' ';' | '{' Tree* '}' ) ;
UseTree : ( Path? '::' )? ( '*' | '{' ( UseTree ( ',' UseTree )* ','? )? '}' ) | Path ( 'as' Id )? ;
Fn : 'default'? 'const'? 'async'? 'unsafe'? ( 'extern' '"'? )? 'fn' Id Generics? '(' FnParams ')' ( '->' Type )? Where? ( Block | ';' ) ;
FnParams : ( FnParam ( ',' FnParam )* ','? )? ;
FnParam : Attr* ( SelfParam | Pattern ':' Type | '...' ) ;
SelfParam : ( '&' 'life'? )? 'mut'? 'self' ( ':' Type )? ;
Generics : '<' ( GenericParam ( ',' GenericParam )* ','? )? '>' ;
GenericParam : Attr* ( 'life' ( ':' Bounds? )? | Id ( ':' Bounds? )? ( '=' Type )? | 'const' Id ':' Type ( '=' ( '0' | 'true' | 'false' | Block ) )? ) ;
Where : 'where' ( WhereItem ( ',' WhereItem )* ','? )? ;
WhereItem : 'life' ':' Bounds? | ForLives? Type ':' Bounds? ;
ForLives : 'for' Generics ;
Bounds : Bound ( '+' Bound )* '+'? ;
Bound : 'life' | '(' Bound ')' | '?'? ForLives? Path | 'use' Generics ;
Struct : 'struct' Id Generics? ( Where? '{' ( NamedField ( ',' NamedField )* ','? )? '}' | '(' ( TupleField ( ',' TupleField )* ','? )? ')' Where? ';' | Where? ';' ) ;
NamedField : Attr* Vis? Id ':' Type ;
TupleField : Attr* Vis? Type ;
Enum : 'enum' Id Generics? Where? '{' ( Variant ( ',' Variant )* ','? )? '}' ;
Variant : Attr* Vis? Id ( '{' ( NamedField ( ',' NamedField )* ','? )? '}' | '(' ( TupleField ( ',' TupleField )* ','? )? ')' )? ( '=' Expr )? ;
Type : '(' ( Type ( ',' Type )* ','? )? ')' | '!' | '*' ( 'const' | 'mut' ) Type | ( '&' | '&&' ) 'life'? 'mut'? Type | '[' Type ( ';' Expr )? ']' | '_'
     | ForLives? 'unsafe'? ( 'extern' '"'? )? 'fn' '(' ( FnTypeParam ( ',' FnTypeParam )* ','? )? ')' ( '->' Type )? | 'impl' Bounds | 'dyn' Bounds | ForLives? Path | Path '!' ( '(' Tree* ')' | '[' Tree* ']' ) ;
FnTypeParam : ( ( Id | '_' ) ':' )? Type | '...' ;
Path : '::'? Seg ( '::' Seg )* | '<' Type ( 'as' Path )? '>' ( '::' Seg )+ ;
Seg : SegName ( '::'? TypeArgs )? | SegName '::'? '(' ( Type ( ',' Type )* ','? )? ')' ( '->' Type )? ;
SegName : Id | 'self' | 'Self' | 'super' | 'crate' ;
ExprPath : '::'? ESeg ( '::' ESeg )* | '<' Type ( 'as' Path )? '>' ( '::' ESeg )+ ;
ESeg : SegName ( '::' TypeArgs )? ;
TypeArgs : '<' ( TypeArg ( ',' TypeArg )* ','? )? '>' ;
TypeArg : 'life' | Type | '+-'? '0' | '"' | 'true' | 'false' | Block | Id TypeArgs? ( '=' Type | ':' Bounds ) ;
Pattern : '|'? Pat ( '|' Pat )* ;
Pat : 'ref'? 'mut'? Id ( '@' Pat )? | '_' | '..' | ( '&' | '&&' ) 'mut'? Pat | '(' ( Pattern ( ',' Pattern )* ','? )? ')' | '[' ( Pattern ( ',' Pattern )* ','? )? ']'
    | ExprPath | ExprPath '(' ( Pattern ( ',' Pattern )* ','? )? ')' | ExprPath '{' ( FieldPat ( ',' FieldPat )* ','? )? '}' | PatLit | PatLit? ( '..=' | '..' | '...' ) PatEnd? | ExprPath ( '..=' | '..' | '...' ) PatEnd? | Path '!' ( '(' Tree* ')' | '[' Tree* ']' ) ;
PatLit : '+-'? '0' | '"' | 'true' | 'false' ;
PatEnd : PatLit | ExprPath ;
FieldPat : Attr* ( ( Id | '0' ) ':' Pattern | 'ref'? 'mut'? Id ) | '..' ;
Block : '{' InnerAttr* Stmt* Expr? '}' ;
Stmt : ';' | Item | Attr* 'let' Pattern ( ':' Type )? ( '=' Expr ( 'else' Block )? )? ';' | Attr* Expr ';' | Attr* BlockLike ;
BlockLike : ( 'life' ':' )? ( Block | 'loop' Block | 'while' Cond Block | 'for' Pattern 'in' Expr Block ) | 'unsafe' Block | 'async' 'move'? Block | 'const' Block | If | Match | Path '!' '{' Tree* '}' ;
If : 'if' Cond Block ( 'else' ( If | Block ) )? ;
Cond : CondPart ( '&&' CondPart )* ;
CondPart : Expr | 'let' Pattern '=' Expr ;
Match : 'match' Expr '{' InnerAttr* ( Arm* LastArm )? '}' ;
Arm : Attr* Pattern ( 'if' Cond )? '=>' ( Expr ',' | BlockLike ','? ) ;
LastArm : Attr* Pattern ( 'if' Cond )? '=>' Expr ','? ;
Expr : Operand ( BinOp Operand )* | RangeHead? ( '..' | '..=' ) ( Operand ( BinOp Operand )* )? | Closure | Operand ( BinOp Operand )* BinOp Closure ;
RangeHead : Operand ( BinOp Operand )* ;
BinOp : 'op' | '*' | '+-' | '+' | '&' | '&&' | '|' | '||' | '<' | '>' | '>=' | '>' '>' | '>' '>=' | '=' | 'op=' ;
Operand : Unary ( 'as' Type )* | 'return' Expr? | 'break' 'life'? Expr? | 'continue' 'life'? ;
Closure : 'static'? 'async'? 'move'? ( '|' ( ClosureParam ( ',' ClosureParam )* ','? )? '|' | '||' ) ( Expr | '->' Type Block ) ;
ClosureParam : Attr* Pat ( ':' Type )? ;
Unary : ( '+-' | '!' | '*' | '&' | '&&' | '&' 'mut' | '&&' 'mut' | '&' Id ( 'const' | 'mut' ) )* Postfix ;
Postfix : Primary | Postfix '?' | Postfix '.' ( Id ( '::' TypeArgs )? | '0' | 'await' ) | Postfix '(' CallArgs ')' | Postfix '[' Expr ']' ;
CallArgs : ( Attr* Expr ( ',' Attr* Expr )* ','? )? ;
Primary : '0' | '"' | 'true' | 'false' | ExprPath | '_' | '(' ( Attr* Expr ( ',' Expr )* ','? )? ')' | '[' ( Expr ( ',' Expr )* ','? | Expr ';' Expr )? ']' | ExprPath '{' ( FieldInit ( ',' FieldInit )* )? ','? ( '..' Expr? )? '}'
        | BlockLike | Path '!' ( '(' Tree* ')' | '[' Tree* ']' ) ;
FieldInit : Attr* ( Id | '0' ':' Expr | Id ':' Expr ) ;
"""
_RUST_TOKENS = ["a", "0", '"', "life", ";", ",", ":", "::", ".", "..", "..=", "...", "=", "op", "op=", "*", "+-", "+", "&", "&&", "|", "||", "<", ">", ">=", "!", "?", "#", "$", "@", "->", "=>", "_", "~", *RUST_KEYWORDS]
RUST = RUST % {"leaves": " | ".join(f"'{t}'" for t in _RUST_TOKENS)}

C_KEYWORDS = (
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef "
    "union unsigned void volatile while _Bool _Complex _Alignas _Alignof _Atomic _Generic _Noreturn _Static_assert _Thread_local __attribute__ __asm__ asm __extension__ __inline __inline__ __restrict static_assert typeof __typeof__ bool"
).split()

C = """
Unit : External* ;
External : 'a'? FunctionDef | 'a'? Declaration | ';' | 'a' '(' MacroArgs? ')' ';'? | Asm ';' | 'extern' '"' '{' External* '}' ;
MacroArgs : MacroArg ( ',' MacroArg )* ;
MacroArg : Assign | TypeName ;
FunctionDef : Specs Declarator Attribute* Compound ;
Declaration : Specs ( InitDeclarator ( ',' InitDeclarator )* )? ';' | StaticAssert ;
StaticAssert : ( '_Static_assert' | 'static_assert' ) '(' Cond ( ',' '"' )? ')' ';' ;
Specs : Qual* ( Builtin ( Builtin | Qual )* | Record Qual* | 'a' Qual* | Typeof Qual* | 'a' Qual* Builtin ( Builtin | Qual )* | 'a' Qual* Record Qual* ) ;
Qual : 'static' | 'extern' | 'typedef' | 'inline' | '__inline' | '__inline__' | 'register' | 'auto' | 'const' | 'volatile' | 'restrict' | '__restrict' | '_Noreturn' | '_Thread_local' | '_Atomic' | '__extension__' | Attribute
     | '_Alignas' '(' ( TypeName | Cond ) ')' ;
Builtin : 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | 'bool' | '_Complex' ;
Typeof : ( 'typeof' | '__typeof__' ) '(' ( TypeName | Expr ) ')' ;
Attribute : '__attribute__' '(' '(' Balanced* ')' ')' | '[' '[' Balanced* ']' ']' ;
Balanced : 'a' | '0' | '"' | ',' | '(' Balanced* ')' | ':' | '.' | 'const' | 'void' | 'int' | 'char' | 'long' | 'unsigned' | 'struct' | 'sizeof' | 'op' | '*' | '&' | '+-' | '=' ;
Asm : ( 'asm' | '__asm__' ) 'volatile'? '(' AsmPart* ')' ;
AsmPart : '"' | ':' | ',' | '(' Expr ')' | '[' 'a' ']' ;
Record : ( 'struct' | 'union' ) Attribute* ( 'a'? '{' FieldDecl* '}' | 'a' ) Attribute* | 'enum' ( 'a'? '{' Enumerator ( ',' Enumerator )* ','? '}' | 'a' ) ;
FieldDecl : Specs ( FieldDeclarator ( ',' FieldDeclarator )* )? ';' | StaticAssert | ';' ;
FieldDeclarator : Declarator? ':' Cond | Declarator Attribute* ;
Enumerator : 'a' Attribute* ( '=' Cond )? ;
InitDeclarator : Declarator Asm? Attribute* ( '=' Initializer )? ;
Declarator : Pointer* Direct ;
Pointer : '*' Qual* ;
Direct : 'a' | '(' Attribute* Declarator ')' | Direct '[' ( 'static' | Qual )* ( Assign | '*' )? ']' | Direct '(' ParamTypes ')' ;
ParamTypes : ( ParamDecl ( ',' ParamDecl )* ( ',' '...' )? )? ;
ParamDecl : Specs Declarator Attribute* | Specs Abstract? ;
Abstract : Pointer+ | Pointer* DirectAbstract ;
DirectAbstract : '(' Abstract ')' | DirectAbstract? '[' ( 'static' | Qual )* ( Assign | '*' )? ']' | DirectAbstract? '(' ParamTypes ')' ;
TypeName : Specs Abstract? ;
Initializer : Assign | '{' ( InitItem ( ',' InitItem )* ','? )? '}' ;
InitItem : ( Designator+ '=' | 'a' ':' )? Initializer ;
Designator : '.' 'a' | '[' Cond ( '...' Cond )? ']' ;
Compound : '{' ( Declaration | Stmt )* '}' ;
Stmt : Compound | Expr? ';' | 'if' '(' Expr ')' Stmt ( 'else' Stmt )? | 'switch' '(' Expr ')' Stmt | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';'
     | 'for' '(' ( Declaration | Expr? ';' ) Expr? ';' Expr? ')' Stmt | 'goto' ( 'a' | '*' Expr ) ';' | 'continue' ';' | 'break' ';' | 'return' Expr? ';' | 'a' ':' Attribute* Stmt? | 'case' Cond ( '...' Cond )? ':' CaseBody | 'default' ':' CaseBody | Asm ';' ;
CaseBody : Stmt | Declaration | ;
Expr : Assign ( ',' Assign )* ;
Assign : Cond | Unary ( '=' | 'op=' ) Assign ;
Cond : Binary ( '?' Expr? ':' Cond )? ;
Binary : Cast ( ( 'op' | '*' | '&' | '+-' ) Cast )* ;
Cast : Unary | '(' TypeName ')' Cast ;
Unary : Postfix | '++' Unary | ( '&' | '*' | '+-' | '!' | '~' ) Cast | 'sizeof' Unary | ( 'sizeof' | '_Alignof' ) '(' TypeName ')' ;
Postfix : Primary | Postfix '[' Expr ']' | Postfix '(' ( MacroArgs )? ')' | Postfix ( '.' | '->' ) 'a' | Postfix '++' | '(' TypeName ')' '{' ( InitItem ( ',' InitItem )* ','? )? '}' ;
Primary : 'a' | '0' | Strings | '(' Expr ')' | '(' Compound ')' | '_Generic' '(' Assign ( ',' ( TypeName | 'default' ) ':' Assign )+ ')' ;
Strings : '"' ( '"' | 'a' '"' )* ;
"""
