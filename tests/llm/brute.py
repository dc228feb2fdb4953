"""Plain Python versions of the contracts, for small tables."""

import hashlib
import re
from collections import Counter
W=re.compile(r"[^\x20\x09-\x0D]+")
sha=lambda s: hashlib.sha256(s.encode()).hexdigest()
ASSIGN=re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
def op2(t):
    sp=[]
    sp+=[(m.start(),0,"assign",m.end()) for m in ASSIGN.finditer(t) if len(m[2])>=8]
    sp+=[(m.start(),1,"access",m.end()) for m in re.finditer("AKIA[A-Z0-9]+",t) if len(m[0])>=16]
    sp+=[(m.start(),2,"hex",m.end()) for m in re.finditer("[0-9a-f]+",t) if len(m[0])>=32]
    sp.sort(); c=Counter(x[2] for x in sp)
    return (c["assign"],c["access"],c["hex"],sha(",".join(f"{k}:{s}:{e}" for s,_,k,e in sp)))
def luhn(d):
    t=0
    for i,c in enumerate(reversed(d)):
        x=int(c)
        if i%2: x*=2; x-=9*(x>9)
        t+=x
    return t%10==0
def op9(t):
    sp=[(m.start(),0,"email",m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",t)]
    sp+=[(m.start(),1,"ip",m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",t) if all(int(x)<=255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+",t):
        d=re.sub(r"\D","",m[0])
        if 12<=len(d)<=19 and luhn(d): sp.append((m.start(),2,"card",m.end()))
    sp+=[(m.start(),3,"phone",m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]",t) if 9<=len(re.sub(r"\D","",m[0]))<=15]
    sp.sort(); c=Counter(x[2] for x in sp)
    return (c["email"],c["ip"],c["card"],c["phone"],sha(",".join(f"{k}:{s}:{e}" for s,_,k,e in sp)))
def op7(t):
    w=W.findall(t); win=Counter(tuple(w[i:i+3]) for i in range(len(w)-2)); cov=set()
    for i in range(len(w)-2):
        if win[tuple(w[i:i+3])]>1: cov|={i,i+1,i+2}
    ls=[l for l in t.split("\n") if W.search(l)]
    return (len(w),sum(map(len,w)),len(re.findall(r"[#*$%&|<>]",t)),len(ls)-len(set(ls)),len(cov),len(w)<50 or 100*len(cov)>50*len(w))
def op10(docs):
    ids=sorted(docs,reverse=True); out={}
    for i,k in enumerate(ids):
        t=docs[k]; n=len(t); q=n//3; nx=docs[ids[(i+1)%len(ids)]]
        out[k]=(n,sha(t[:n-q]+nx[:q]))
    return out
def op6(docs):
    """docs: dict id->text; brute force by a set of window hashes."""
    L=200; c=Counter(); enc={k:t.encode() for k,t in docs.items()}
    for b in enc.values():
        for i in range(len(b)-L+1): c[hash(b[i:i+L])]+=1
    out={}
    for k,b in enc.items():
        n=len(b); cov=bytearray(n); 
        last=-1
        for i in range(n-L+1):
            if c[hash(b[i:i+L])]>1:
                for j in range(max(i,last),i+L): cov[j]=1
                last=i+L
        rem=sum(cov); spans=sum(1 for i in range(n) if cov[i] and (i==0 or not cov[i-1]))
        out[k]=(n,rem,spans,hashlib.sha256(bytes(x for x,y in zip(b,cov) if not y)).hexdigest())
    return out

def op3(docs):
    sets={}
    for k,t in docs.items():
        low="".join(chr(ord(c)+32) if "A"<=c<="Z" else c for c in t)
        w=W.findall(low); sets[k]=frozenset(tuple(w[i:i+5]) for i in range(len(w)-4)) if len(w)>=5 else (frozenset([tuple(w)]) if w else frozenset())
    root={k:k for k in docs}
    def find(x):
        while root[x]!=x: root[x]=root[root[x]]; x=root[x]
        return x
    inv={}
    for k,s in sets.items():
        for x in s: inv.setdefault(x,[]).append(k)
    for k,s in sets.items():
        c=Counter()
        for x in s:
            l=inv[x]
            if len(l)>1: c.update(l)
        for j,i in c.items():
            if j!=k and 100*i>=80*(len(s)+len(sets[j])-i):
                a,b=find(k),find(j)
                if a!=b: root[max(a,b)]=min(a,b)
    return {k:(len(sets[k]),find(k)) for k in docs}
