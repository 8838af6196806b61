"""Small inputs of each text format."""

TANK = """; ModuleID = 'lib/tank.c'

%tank = type { i32, i32 }

define i32 @refill(%tank* %t, i32 %want) nounwind {
start:
  %level = getelementptr inbounds %tank* %t, i32 0, i32 1, !dbg !31
  %now = load i32* %level, align 4, !dbg !31
  %low = icmp ult i32 %now, %want, !dbg !32
  br i1 %low, label %pump, label %full, !dbg !32

pump:                                             ; preds = %pump, %start
  %got = call i32 @pour(%tank* %t, i32 8), !dbg !33
  call void @settle(i32 %got), !dbg !34
  %again = icmp ult i32 %got, %want, !dbg !35
  br i1 %again, label %pump, label %full, !dbg !35

full:                                             ; preds = %pump, %start
  %left = phi i32 [ %now, %start ], [ %got, %pump ]
  ret i32 %left, !dbg !36
}

declare i32 @pour(%tank*, i32)

declare void @settle(i32)

define void @shift() nounwind {
start:
  %n = call i32 @refill(%tank* null, i32 64), !dbg !37
  ret void, !dbg !38
}

!llvm.dbg.cu = !{!0}

!0 = metadata !{i32 720913, i32 0, i32 12, metadata !"lib/tank.c", metadata !"/home/dev/plant", metadata !"cc", i1 true}
!1 = metadata !{i32 720942, i32 0, metadata !2, metadata !"refill", metadata !"refill", metadata !"", metadata !2, i32 41, metadata !3, i1 false, i1 true, i32 0, i32 0, i32 0, i32 256, i1 false, i32 (%tank*, i32)* @refill, null, null, metadata !4}
!2 = metadata !{i32 720937, metadata !"lib/tank.c", metadata !"/home/dev/plant", null}
!5 = metadata !{i32 720942, i32 0, metadata !2, metadata !"shift", metadata !"shift", metadata !"", metadata !2, i32 55, metadata !3, i1 false, i1 true, i32 0, i32 0, i32 0, i32 0, i1 false, void ()* @shift, null, null, metadata !4}
!31 = metadata !{i32 42, i32 5, metadata !1, null}
!32 = metadata !{i32 43, i32 5, metadata !1, null}
!33 = metadata !{i32 45, i32 9, metadata !1, null}
!34 = metadata !{i32 46, i32 9, metadata !1, null}
!35 = metadata !{i32 47, i32 9, metadata !1, null}
!36 = metadata !{i32 49, i32 5, metadata !1, null}
!37 = metadata !{i32 56, i32 5, metadata !5, null}
!38 = metadata !{i32 57, i32 1, metadata !5, null}
"""

NESTED = """define void @grid(i32 %n) {
entry:
  br label %a

a:
  %x = icmp eq i32 %n, 1
  br i1 %x, label %b, label %out

b:
  %y = icmp eq i32 %n, 2
  br i1 %y, label %c, label %a.next

c:
  %z = icmp eq i32 %n, 3
  br i1 %z, label %body, label %b.next

body:
  br label %c

b.next:
  br label %b

a.next:
  %w = icmp eq i32 %n, 4
  br i1 %w, label %out, label %a.step

a.step:
  br label %a

out:
  ret void
}

define void @choose(i1 %p) {
entry:
  br i1 %p, label %then, label %else

then:
  br label %end

else:
  br label %end

end:
  ret void
}

define void @spin(i1 %p) {
entry:
  br label %head

head:
  br i1 %p, label %body, label %out

body:
  br label %next

next:
  br label %head

out:
  ret void
}

define void @main() {
entry:
  ret void
}
"""

#: Two hunks of a source, and files that were created, deleted and are no source.
PATCH = """Refill in smaller steps

--- lib/tank.c\t2021-03-04 05:06:07.000000000 +0100
+++ lib/tank.c\t2021-03-05 06:07:08.000000000 +0100
@@ -3,4 +3,5 @@
 p
+q
 r
 s
 t
@@ -20,5 +21,4 @@ shift
 u
-v
-w
+x
 y
 z
--- /dev/null
+++ valve.c
@@ -0,0 +1,2 @@
+one
+two
--- pipe.c
+++ /dev/null
@@ -1,1 +0,0 @@
-one
--- todo.txt 2021-03-04 05:06:07
+++ todo.txt 2021-03-04 05:06:09
@@ -1 +1 @@
-one
+two
"""
HUNKS = [(3, 3, "~+~~~"), (20, 21, "~--+~~")]

#: Lines of a hunk that look like a header, and a header right after a hunk.
DASHES = """--- a.sql
+++ a.sql
@@ -1,2 +1,2 @@
 x
--- y
+++ z
--- b.c
+++ b.c
@@ -1 +1,2 @@
 x
+y
"""

#: The last line of context, which was blank, is cut off.
CUT_PATCH = """--- a.c
+++ a.c
@@ -1,4 +1,5 @@
 a
+b
 c
 d
"""
CUT_HUNKS = [(1, 1, "~+~~~")]

#: Lines 45 and 47 of the new file were added.
COMPACT = """****
smaller.diff
====
lib/tank.c
####44,44
~+~+~
"""

PROFILE = """====
SYSCALL
====
open
read
====
EXPCALL
====
sort
====
SYSCALL
====
read
"""
